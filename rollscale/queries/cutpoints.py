"""Cut points, planes and what they imply."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spatial
from ..operators import cuts, records, trajectory
from ..panel import TRUE_WEIGHTS
from .base_sql import scored_from
from .catalog import query

# Points of the panel: real and absent votes of served members on the first axis.
POINTS = """pts AS (SELECT rollcall_id, legislator_id, x1, x2, x1 AS proj, vote
  FROM votes JOIN state USING (legislator_id, period)),
cand AS (SELECT *, coalesce((proj + lag(proj) OVER w) / 2.0, proj - 0.001) AS cut,
    row_number() OVER w - 1 AS idx,
    coalesce(count(*) FILTER (WHERE vote) OVER b, 0) AS yes_left,
    coalesce(count(*) FILTER (WHERE NOT vote) OVER b, 0) AS no_left,
    count(*) FILTER (WHERE vote) OVER r AS yes_all,
    count(*) FILTER (WHERE NOT vote) OVER r AS no_all
  FROM pts WINDOW r AS (PARTITION BY rollcall_id),
    w AS (PARTITION BY rollcall_id ORDER BY proj, legislator_id),
    b AS (PARTITION BY rollcall_id ORDER BY proj, legislator_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SIDES = """sides AS (
  SELECT rollcall_id, idx, cut, 1 AS po, 'yes_low' AS polarity, yes_left AS correct_low,
    no_left AS error_low, no_all - no_left AS correct_high, yes_all - yes_left AS error_high FROM cand
  UNION ALL
  SELECT rollcall_id, idx, cut, 2, 'no_low', no_left, yes_left, yes_all - yes_left, no_all - no_left
  FROM cand),
rated AS (SELECT *, error_low + error_high AS errors,
    correct_low + error_low + correct_high + error_high AS classified,
    CASE WHEN correct_low + error_low + correct_high + error_high > 0
      THEN (error_low + error_high)::DOUBLE / (correct_low + error_low + correct_high + error_high)
      ELSE 999.0 END AS error_rate FROM sides),
tied AS (SELECT * FROM (SELECT *, min(error_rate) OVER (PARTITION BY rollcall_id, po) AS best FROM rated)
  WHERE error_rate - best <= 0.00001),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rollcall_id, po
    ORDER BY abs(cut), idx) AS n FROM tied) WHERE n = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rollcall_id
    ORDER BY error_rate, po) AS m FROM chosen) WHERE m = 1)"""
SORTED = f"WITH {POINTS}"
CUT = f"WITH {POINTS},\n{SIDES}"
CLASSIFIED = CUT + """,
classed AS (SELECT p.*, b.cut, b.polarity,
    CASE WHEN proj < b.cut THEN 'low' WHEN proj > b.cut THEN 'high' END AS side,
    CASE WHEN vote IS NULL OR proj = b.cut THEN -1
      WHEN (proj < b.cut) = (vote = (b.polarity = 'yes_low')) THEN 0 ELSE 1 END AS error
  FROM pts p JOIN best b USING (rollcall_id))"""
COUNTS = "correct_low:l error_low:l correct_high:l error_high:l errors:l classified:l"


def points(p):
    joined = p.votes.join(p.state, ["legislator_id", "period"])
    return joined.withColumn("proj", F.col("x1"))


def classified(p):
    pts = points(p)
    return cuts.classify(pts, cuts.best_cuts(pts))


@query(
    "rollcall_id:l legislator_id:l proj:d position:l",
    SORTED + " SELECT *, idx + 1 AS position FROM cand",
)
def stable_argsort(p):
    return cuts.sort_points(points(p))


@query("rollcall_id:l idx:l cut:d", SORTED + " SELECT * FROM cand")
def cut_candidates(p):
    return cuts.cut_candidates(points(p))


@query(
    "rollcall_id:l idx:l polarity:s correct_low:l error_low:l correct_high:l error_high:l error_rate:d",
    CUT + " SELECT * FROM rated",
)
def cut_running_counts(p):
    return cuts.polarity_counts(cuts.cut_candidates(points(p)))


@query(
    f"rollcall_id:l cut:d {COUNTS} error_rate:d",
    CUT + " SELECT * FROM chosen WHERE po = 1",
)
def best_cut(p):
    """Best cut with the yes side fixed to the low end."""
    return cuts.best_cuts(points(p), fixed=F.lit("yes_low"))


@query(
    "rollcall_id:l polarity:s errors:l",
    CUT + " SELECT * FROM best",
)
def best_polarity(p):
    return cuts.best_cuts(points(p))


@query(
    f"rollcall_id:l polarity:s cut:d {COUNTS} error_rate:d",
    CUT + " SELECT * FROM best",
)
def best_cut_point(p):
    return cuts.best_cuts(points(p))


@query(
    "rollcall_id:l side:s error:i members:l c1:d c2:d",
    CLASSIFIED
    + """ SELECT rollcall_id, side, error, count(*) AS members, avg(x1) AS c1, avg(x2) AS c2
FROM classed WHERE error >= 0 GROUP BY 1, 2, 3""",
    digits=11,
)
def cut_centroids(p):
    return cuts.centroids(classified(p))


@query(
    "rollcall_id:l mean_yes:d mean_no:d n_yes:l n_no:l",
    SORTED
    + """ SELECT rollcall_id, coalesce(avg(proj) FILTER (WHERE vote), 0.0) AS mean_yes,
  coalesce(avg(proj) FILTER (WHERE NOT vote), 0.0) AS mean_no,
  count(*) FILTER (WHERE vote) AS n_yes, count(*) FILTER (WHERE NOT vote) AS n_no
FROM pts GROUP BY 1""",
    digits=11,
)
def cut_projection_means(p):
    return cuts.projection_means(points(p))


@query(
    "legislator_id:l errors:l classified:l",
    CLASSIFIED
    + """ SELECT legislator_id, count(*) FILTER (WHERE error = 1) AS errors,
  count(*) FILTER (WHERE error >= 0) AS classified FROM classed GROUP BY 1""",
)
def cut_errors_by_member(p):
    return cuts.errors_by_member(classified(p))


@query(
    "classified:l errors:l error_rate:d accuracy:d",
    CUT
    + """ SELECT *, errors::DOUBLE / classified AS error_rate, 1.0 - errors::DOUBLE / classified AS accuracy
FROM (SELECT sum(classified) AS classified, sum(errors) AS errors FROM best)""",
)
def cut_accuracy(p):
    return cuts.accuracy(cuts.best_cuts(points(p)))


@query(
    "rollcall_id:l z1:d z2:d d1:d d2:d",
    CUT
    + """ SELECT rollcall_id, cut / greatest(1.0::DOUBLE, abs(cut)) AS z1, 0.0 AS z2,
  CASE WHEN polarity = 'yes_low' THEN 0.5 ELSE -0.5 END AS d1, 0.0 AS d2 FROM best""",
)
def cut_starts(p):
    best = cuts.best_cuts(points(p))
    return cuts.starts_from_cuts(best.withColumns({"n1": F.lit(1.0), "n2": F.lit(0.0)}))


# One turn of every roll call whose last cut still had errors: cut along the normal, move the right
# voters onto the plane, turn the normal to the flattest direction of the moved cloud.
TURNED = """
SELECT rollcall_id, turn, n1, n2, cut, polarity, errors, classified,
  CASE WHEN m1 < 0 OR (m1 = 0 AND m2 < 0) THEN -m1 ELSE m1 END AS m1,
  CASE WHEN m1 < 0 OR (m1 = 0 AND m2 < 0) THEN -m2 ELSE m2 END AS m2
FROM (SELECT *, -sin(angle) AS m1, cos(angle) AS m2
  FROM (SELECT rollcall_id, any_value(turn) AS turn, any_value(n1) AS n1, any_value(n2) AS n2,
      any_value(cut) AS cut, any_value(polarity) AS polarity, any_value(errors) AS errors,
      any_value(yes_all + no_all) AS classified,
      0.5 * atan2(2.0 * covar_pop(y1, y2), var_pop(y1) - var_pop(y2)) AS angle
    FROM (SELECT *, x1 + move * n1 AS y1, x2 + move * n2 AS y2
      FROM (SELECT *, CASE WHEN vote <> ((proj < cut) = (polarity = 'yes_low')) THEN 0.0
          ELSE cut - proj END AS move
        FROM (SELECT *,
            CASE WHEN err_yes[1] <= err_no[1] THEN 'yes_low' ELSE 'no_low' END AS polarity,
            CASE WHEN err_yes[1] <= err_no[1] THEN err_yes[1] ELSE err_no[1] END AS errors,
            CASE WHEN err_yes[1] <= err_no[1] THEN err_yes[4] ELSE err_no[4] END AS cut
          FROM (SELECT *,
              min(CASE WHEN e_yes - least_yes <= 0.00001 * greatest(yes_all + no_all, 1)
                THEN [abs(spot), idx, e_yes, spot] END) OVER r AS pick_yes,
              min(CASE WHEN e_no - least_no <= 0.00001 * greatest(yes_all + no_all, 1)
                THEN [abs(spot), idx, e_no, spot] END) OVER r AS pick_no,
              [pick_yes[3], pick_yes[1], pick_yes[2], pick_yes[4]] AS err_yes,
              [pick_no[3], pick_no[1], pick_no[2], pick_no[4]] AS err_no
            FROM (SELECT *, min(e_yes) OVER r AS least_yes, min(e_no) OVER r AS least_no
              FROM (SELECT *, no_left + yes_all - yes_left AS e_yes,
                  yes_left + no_all - no_left AS e_no,
                  coalesce((proj + before) / 2.0, proj - 0.001) AS spot
                FROM (SELECT *, lag(proj) OVER w AS before, row_number() OVER w - 1 AS idx,
                    coalesce(count(*) FILTER (WHERE vote) OVER b, 0) AS yes_left,
                    coalesce(count(*) FILTER (WHERE NOT vote) OVER b, 0) AS no_left,
                    count(*) FILTER (WHERE vote) OVER r AS yes_all,
                    count(*) FILTER (WHERE NOT vote) OVER r AS no_all
                  FROM (SELECT rollcall_id, legislator_id, vote, x1, x2, turn + 1 AS turn,
                      m1 AS n1, m2 AS n2, x1 * m1 + x2 * m2 AS proj
                    FROM turns JOIN pts USING (rollcall_id) WHERE turn < 24 AND errors > 0)
                  WINDOW r AS (PARTITION BY rollcall_id),
                    w AS (PARTITION BY rollcall_id ORDER BY proj, legislator_id),
                    b AS (PARTITION BY rollcall_id ORDER BY proj, legislator_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
              WINDOW r AS (PARTITION BY rollcall_id))
            WINDOW r AS (PARTITION BY rollcall_id)))))
    GROUP BY rollcall_id))"""
PLANES = f"""WITH RECURSIVE pts AS (SELECT rollcall_id, legislator_id, x1, x2, vote
  FROM votes JOIN state USING (legislator_id, period)),
turns AS (
  SELECT DISTINCT rollcall_id, -1::BIGINT AS turn, 0.0::DOUBLE AS n1, 0.0::DOUBLE AS n2,
    0.0::DOUBLE AS cut, '' AS polarity, 1.0::DOUBLE AS errors, 0::BIGINT AS classified,
    1.0::DOUBLE AS m1, 0.0::DOUBLE AS m2 FROM pts
  UNION ALL {TURNED}),
ranked AS (SELECT *, min(errors) OVER r AS least,
    max(errors) FILTER (WHERE turn = 0) OVER r AS first_errors
  FROM turns WHERE turn >= 0 WINDOW r AS (PARTITION BY rollcall_id)),
plane AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rollcall_id
    ORDER BY turn DESC) AS k FROM ranked WHERE errors = least) WHERE k = 1)"""


@query(
    "rollcall_id:l turn:i n1:d n2:d cut:d polarity:s errors:l first_errors:l classified:l",
    PLANES + " SELECT * FROM plane",
)
def cutting_plane(p):
    from ..plans.planes import cutting_planes

    return cutting_planes(p.votes, p.state)


@query("rollcall_id:l turn:i errors:l", PLANES + " SELECT * FROM plane")
def best_rotation(p):
    """Fewest errors over the turns of the search for the plane, the last of the ties."""
    from ..plans.planes import turns_taken

    return cuts.best_turn(turns_taken(p.votes, p.state))


def _steps_sql(key: str, rates: str, position: str, spread: str, points: int, order: str) -> str:
    """Points along the gradient of every group, their GMP and the best of them."""
    tried = f"""SELECT {key}, step, vote, {position.format(k=1)} AS x1, {position.format(k=2)} AS x2,
    z1, z2, {spread.format(k=1)} AS d1, {spread.format(k=2)} AS d2
  FROM moved, range(0, {points}) AS r(step)"""
    return f"""WITH t AS (SELECT legislator_id, period, CASE WHEN count(*) OVER m > 1
      THEN (row_number() OVER o - 1) * (2.0::DOUBLE / (count(*) OVER m - 1)) - 1.0 ELSE -1.0 END AS t
    FROM placements WINDOW m AS (PARTITION BY legislator_id), o AS (PARTITION BY legislator_id ORDER BY period)),
g AS (SELECT *, sqrt(g1 * g1 + g2 * g2) AS norm FROM (
  SELECT {key}, {rates} FROM derived JOIN t USING (legislator_id, period) GROUP BY 1)),
moved AS (SELECT s.*, t.t, g.g1 / g.norm AS u1, g.g2 / g.norm AS u2
  FROM star s JOIN t USING (legislator_id, period) JOIN g USING ({key}) WHERE g.norm > 0),
gmps AS (SELECT {key}, step, round(exp(sum(ll) / count(*)), 9) AS gmp FROM ({scored_from(tried)}) GROUP BY ALL)
SELECT {key}, step, gmp FROM (SELECT *, row_number() OVER (PARTITION BY {key}
  ORDER BY gmp DESC, {order}) AS n FROM gmps) WHERE n = 1"""


def _line(p, key: str, first, second):
    """Star rows with the unit gradient (u1, u2) of their group and the local time."""
    grid = trajectory.served_grid(p.placements).select("legislator_id", "period", "t")
    terms = spatial.with_derivatives(p.scored, TRUE_WEIGHTS).join(grid, ["legislator_id", "period"])
    sums = terms.groupBy(key).agg(first.alias("g1"), second.alias("g2"))
    norm = F.sqrt(F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2"))
    units = sums.withColumn("norm", norm).where("norm > 0").selectExpr(key, "g1 / norm as u1", "g2 / norm as u2")
    return p.star.join(grid, ["legislator_id", "period"]).join(units, key)


@query(
    "rollcall_id:l step:i gmp:d",
    _steps_sql(
        "rollcall_id", "sum(gd1) AS g1, sum(gd2) AS g2", "x{k}", "d{k} - step * 0.01 * u{k}", 25, "step"
    ),
)
def best_step(p):
    """Point of the spread search with the highest GMP, the first of the ties."""
    rows = _line(p, "rollcall_id", F.sum("gd1"), F.sum("gd2"))
    rows = rows.withColumns(
        {"u_x1": F.lit(0.0), "u_x2": F.lit(0.0), "u_d1": F.col("u1"), "u_d2": F.col("u2")}
    )
    steps = records.line_steps(rows, TRUE_WEIGHTS, "rollcall_id", 25)
    return cuts.best_step(steps.withColumn("gmp", F.round("gmp", 9)), "rollcall_id", first=True)


@query(
    "legislator_id:l step:i gmp:d",
    _steps_sql(
        "legislator_id", "sum(t * gx1) AS g1, sum(t * gx2) AS g2", "x{k} - step * 0.01 * u{k} * t", "d{k}", 10,
        "step DESC",
    ),
)
def best_step_member(p):
    """Point of the search for a linear term, the last of the ties."""
    t = F.col("t")
    rows = _line(p, "legislator_id", F.sum(t * F.col("gx1")), F.sum(t * F.col("gx2")))
    rows = rows.withColumns(
        {"u_x1": F.col("u1") * t, "u_x2": F.col("u2") * t, "u_d1": F.lit(0.0), "u_d2": F.lit(0.0)}
    )
    steps = records.line_steps(rows, TRUE_WEIGHTS, "legislator_id", 10)
    return cuts.best_step(steps.withColumn("gmp", F.round("gmp", 9)), "legislator_id", first=False)
