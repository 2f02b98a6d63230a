"""Comparison of fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, compare, scoring
from ..panel import TRUE_WEIGHTS
from .base_sql import scored_from
from .catalog import query
from .paths import _paths_sql

MATCHED = """matched AS (SELECT legislator_id, period, a."coord1D" AS a1, a."coord2D" AS a2,
    b."coord1D" AS b1, b."coord2D" AS b2 FROM fit_a a JOIN fit_b b USING (legislator_id, period))"""


def _align(by: str | None) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN rot USING ({by})" if by else ", rot"
    return f"""{MATCHED},
mom AS (SELECT {keys}avg(a1) AS ma1, avg(a2) AS ma2, avg(b1) AS mb1, avg(b2) AS mb2,
    sum(a1 * b1) - count(*) * avg(a1) * avg(b1) AS x11,
    sum(a1 * b2) - count(*) * avg(a1) * avg(b2) AS x12,
    sum(a2 * b1) - count(*) * avg(a2) * avg(b1) AS x21,
    sum(a2 * b2) - count(*) * avg(a2) * avg(b2) AS x22 FROM matched {group}),
rot AS (SELECT {keys}ma1, ma2, mb1, mb2, turn >= mirror AS rotates,
    CASE WHEN turn >= mirror THEN (x11 + x22) / turn ELSE (x11 - x22) / mirror END AS r11,
    CASE WHEN turn >= mirror THEN (x12 - x21) / turn ELSE (x12 + x21) / mirror END AS r12,
    CASE WHEN turn >= mirror THEN (x21 - x12) / turn ELSE (x12 + x21) / mirror END AS r21,
    CASE WHEN turn >= mirror THEN (x11 + x22) / turn ELSE (x22 - x11) / mirror END AS r22
  FROM (SELECT *, sqrt((x11 + x22) * (x11 + x22) + (x12 - x21) * (x12 - x21)) AS turn,
    sqrt((x11 - x22) * (x11 - x22) + (x12 + x21) * (x12 + x21)) AS mirror FROM mom)),
aligned AS (SELECT *, sqrt((aligned1 - b1) * (aligned1 - b1) + (aligned2 - b2) * (aligned2 - b2))
    AS displacement, sqrt((a1 - b1) * (a1 - b1) + (a2 - b2) * (a2 - b2)) AS raw_displacement
  FROM (SELECT matched.*, (a1 - ma1) * r11 + (a2 - ma2) * r21 + mb1 AS aligned1,
    (a1 - ma1) * r12 + (a2 - ma2) * r22 + mb2 AS aligned2 FROM matched {join}))"""


SCORES = """count(*) AS matched, corr(aligned1, b1) AS r1, corr(aligned2, b2) AS r2,
  stddev_pop(aligned1) / stddev_pop(b1) AS scale1, stddev_pop(aligned2) / stddev_pop(b2) AS scale2,
  avg(displacement) AS mean_distance, max(displacement) AS max_distance,
  max(raw_displacement) AS raw_max_distance"""
SCORE_COLUMNS = (
    "matched:l r1:d r2:d scale1:d scale2:d mean_distance:d max_distance:d raw_max_distance:d"
)


def matched(p):
    return compare.join_fits(p.fit_a, p.fit_b)


def aligned(p, by=None):
    return compare.align(matched(p), by)


@query(
    "legislator_id:l period:i a1:d a2:d b1:d b2:d",
    f"WITH {MATCHED} SELECT * FROM matched",
)
def fit_join(p):
    return matched(p)


@query(
    "legislator_id:l period:i a1:d b1:d e1:d e2:d",
    f"""WITH {MATCHED} SELECT m.*, e.dim1 AS e1, e.dim2 AS e2 FROM matched m
JOIN external e USING (legislator_id) WHERE dim1 IS NOT NULL""",
)
def three_way_join(p):
    return compare.join_three(p.fit_a, p.external, p.fit_b)


@query(
    "legislator_id:l coord1D:d party:s",
    """SELECT legislator_id, "coord1D", CASE WHEN legislator_id % 8 = 0 THEN 'IND'
  ELSE CAST(party AS VARCHAR) END AS party FROM (SELECT legislator_id, avg("coord1D") AS "coord1D"
  FROM fit_a GROUP BY 1) JOIN roster USING (legislator_id)""",
    digits=11,
)
def party_join(p):
    known = p.roster.select(
        "legislator_id", F.when(F.col("legislator_id") % 8 != 0, F.col("party")).alias("party")
    )
    return compare.with_party(compare.career_mean(p.fit_a), known)


@query(
    "period:i matched:l r1:d r2:d",
    """SELECT period, count(*) AS matched, corr("coord1D", dim1) AS r1, corr("coord2D", dim2) AS r2
FROM fit_a JOIN external USING (legislator_id) WHERE dim1 IS NOT NULL GROUP BY period""",
)
def external_scores(p):
    scores = compare.drop_null_scores(p.external)
    return (
        p.fit_a.join(scores, "legislator_id")
        .groupBy("period")
        .agg(
            F.count("*").alias("matched"),
            F.corr("coord1D", "dim1").alias("r1"),
            F.corr("coord2D", "dim2").alias("r2"),
        )
    )


@query(
    "legislator_id:l period:i",
    "SELECT legislator_id, period FROM placements",
)
def served_semi_join(p):
    """Padded rows (every member of the roster in every period) cut to served ones."""
    padded = p.roster.select(
        "legislator_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("period")
    )
    return compare.served_only(padded, p.placements)


@query(
    "matched:l only_left:l only_right:l duplicates:l",
    """WITH b AS (SELECT legislator_id, period + CASE WHEN legislator_id % 13 = 0 THEN 10 ELSE 0 END AS period
  FROM placements)
SELECT (SELECT count(*) FROM placements JOIN b USING (legislator_id, period)) AS matched,
  (SELECT count(*) FROM placements ANTI JOIN b USING (legislator_id, period)) AS only_left,
  (SELECT count(*) FROM b ANTI JOIN placements USING (legislator_id, period)) AS only_right,
  0 AS duplicates""",
)
def state_one_to_one(p):
    shift = F.when(F.col("legislator_id") % 13 == 0, 10).otherwise(0)
    other = p.placements.withColumn("period", F.col("period") + shift)
    return compare.one_to_one(p.placements, other, ["legislator_id", "period"])


@query(
    "part:s max_difference:d max_distance:d",
    """SELECT 'bills' AS part, max(greatest(abs(a.z1 - b.z1), abs(a.z2 - b.z2), abs(a.d1 - b.d1),
  abs(a.d2 - b.d2))) AS max_difference,
  max(sqrt((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2)
    + (a.d1 - b.d1) * (a.d1 - b.d1) + (a.d2 - b.d2) * (a.d2 - b.d2))) AS max_distance
FROM bills a JOIN bills_b b USING (rollcall_id)
UNION ALL
SELECT 'coordinates', max(greatest(abs(a."coord1D" - b."coord1D"), abs(a."coord2D" - b."coord2D"))),
  max(sqrt((a."coord1D" - b."coord1D") * (a."coord1D" - b."coord1D")
    + (a."coord2D" - b."coord2D") * (a."coord2D" - b."coord2D")))
FROM fit_a a JOIN fit_b b USING (legislator_id, period)""",
)
def state_max_diff(p):
    bills = compare.max_component_difference(
        p.bills, p.bills_b, ["rollcall_id"], ["z1", "z2", "d1", "d2"]
    )
    coords = compare.max_component_difference(
        p.fit_a, p.fit_b, ["legislator_id", "period"], ["coord1D", "coord2D"]
    )
    return bills.withColumn("part", F.lit("bills")).unionByName(
        coords.withColumn("part", F.lit("coordinates"))
    )


@query(
    "n:l r11:d r12:d r21:d r22:d rotation:i",
    f"""WITH {_align(None)} SELECT (SELECT count(*) FROM matched) AS n, *, CAST(rotates AS INTEGER) AS rotation
FROM rot""",
)
def procrustes_single(p):
    return compare.alignment(matched(p))


@query(
    f"period:i {SCORE_COLUMNS}",
    f"WITH {_align('period')} SELECT period, {SCORES} FROM aligned GROUP BY period",
)
def procrustes_period(p):
    return compare.scores(aligned(p, ["period"]), ["period"])


@query(
    f"{SCORE_COLUMNS}",
    f"WITH {_align(None)} SELECT {SCORES} FROM aligned",
)
def procrustes_pooled(p):
    return compare.scores(aligned(p))


@query(
    "mean_distance:d median_distance:d max_distance:d raw_max_distance:d",
    f"""WITH {_align(None)} SELECT {SCORES}, median(displacement) AS median_distance FROM aligned""",
)
def displacement_stats(p):
    return compare.displacement_stats(aligned(p))


@query(
    "period:i r1:d r2:d",
    f"WITH {MATCHED} SELECT period, corr(a1, b1) AS r1, corr(a2, b2) AS r2 FROM matched GROUP BY 1",
)
def pearson(p):
    return matched(p).groupBy("period").agg(
        F.corr("a1", "b1").alias("r1"), F.corr("a2", "b2").alias("r2")
    )


RANKS = f"""WITH {MATCHED},
ranked AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY a1)
    + (count(*) OVER (PARTITION BY period, a1) - 1) / 2.0 AS rank_a,
  rank() OVER (PARTITION BY period ORDER BY b1)
    + (count(*) OVER (PARTITION BY period, b1) - 1) / 2.0 AS rank_b FROM matched)"""


@query("period:i rho:d", RANKS + " SELECT period, corr(rank_a, rank_b) AS rho FROM ranked GROUP BY 1")
def spearman(p):
    return compare.spearman(matched(p), "a1", "b1", ["period"])


@query(
    "legislator_id:l period:i rank_a:d",
    RANKS + " SELECT legislator_id, period, rank_a FROM ranked",
)
def average_rank(p):
    from ..operators.running import average_ranks

    return average_ranks(matched(p), ["period"], "a1", "rank_a")


@query(
    "scale1:d scale2:d",
    f"""WITH {MATCHED} SELECT stddev_pop(a1) / stddev_pop(b1) AS scale1,
  stddev_pop(a2) / stddev_pop(b2) AS scale2 FROM matched""",
)
def scale_ratio(p):
    return matched(p).agg(
        (F.stddev_pop("a1") / F.stddev_pop("b1")).alias("scale1"),
        (F.stddev_pop("a2") / F.stddev_pop("b2")).alias("scale2"),
    )


@query(
    "legislator_id:l period:i coord1D:d",
    """WITH lab AS (SELECT f.*, party FROM fit_b f JOIN roster USING (legislator_id)),
m AS (SELECT avg("coord1D") AS m FROM lab WHERE party = 100)
SELECT legislator_id, period, CASE WHEN m < 0 THEN -"coord1D" ELSE "coord1D" END AS "coord1D" FROM lab, m""",
)
def orient_dim1(p):
    return compare.orient_dim1(compare.with_party(p.fit_b, p.roster), ["100"])


@query(
    "legislator_id:l period:i coord2D:d",
    """WITH r AS (SELECT corr(b."coord2D", a."coord2D") AS r FROM fit_a a JOIN fit_b b USING (legislator_id, period))
SELECT legislator_id, period, CASE WHEN r < 0 THEN -"coord2D" ELSE "coord2D" END AS "coord2D" FROM fit_b, r""",
)
def orient_dim2(p):
    return compare.orient_dim2(p.fit_b, p.fit_a)


@query(
    "r:d matched:l verdict:s",
    """SELECT corr(b."coord2D", a."coord2D") AS r, count(*) AS matched,
  CASE WHEN abs(corr(b."coord2D", a."coord2D")) >= 0.3 THEN 'well determined' ELSE 'ambiguous' END AS verdict
FROM fit_a a JOIN fit_b b USING (legislator_id, period)""",
)
def dim2_gauge(p):
    return compare.dim2_gauge(p.fit_b, p.fit_a)


def _slice_sql(rows: str) -> str:
    return f"""WITH r AS (SELECT corr(b."coord2D", a."coord2D") AS r FROM fit_a a JOIN fit_b b USING (legislator_id, period)),
turned AS (SELECT legislator_id, period, "coord1D", CASE WHEN r < 0 THEN -"coord2D" ELSE "coord2D" END AS "coord2D"
  FROM fit_b, r),
cut AS ({rows}),
lab AS (SELECT cut.*, CAST(party AS VARCHAR) AS party FROM cut JOIN roster USING (legislator_id)),
m AS (SELECT avg("coord1D") AS m FROM lab WHERE party = '100')
SELECT legislator_id, CASE WHEN m < 0 THEN -"coord1D" ELSE "coord1D" END AS "coord1D", "coord2D", party,
  0.0 AS party_score FROM lab, m"""


SLICE_COLUMNS = "legislator_id:l coord1D:d coord2D:d party:s party_score:d"


@query(
    SLICE_COLUMNS,
    _slice_sql(
        """SELECT legislator_id, avg("coord1D") AS "coord1D", avg("coord2D") AS "coord2D" FROM turned GROUP BY 1"""
    ),
    digits=11,
)
def map_slice(p):
    return compare.map_slice(p.fit_b, p.roster, p.fit_a, ["100"])


@query(
    SLICE_COLUMNS,
    _slice_sql("""SELECT legislator_id, "coord1D", "coord2D" FROM turned WHERE period = 4"""),
)
def map_slice_period(p):
    return compare.map_slice(p.fit_b, p.roster, p.fit_a, ["100"], period=4)


@query(
    SLICE_COLUMNS,
    "WITH " + _paths_sql() + """,
r AS (SELECT corr(b."coord2D", a."coord2D") AS r FROM fit_a a JOIN fit_b b USING (legislator_id, period)),
cut AS (SELECT legislator_id, b0_1 AS "coord1D", CASE WHEN r < 0 THEN -b0_2 ELSE b0_2 END AS "coord2D" FROM paths, r),
lab AS (SELECT cut.*, CAST(party AS VARCHAR) AS party FROM cut JOIN roster USING (legislator_id)),
m AS (SELECT avg("coord1D") AS m FROM lab WHERE party = '100')
SELECT legislator_id, CASE WHEN m < 0 THEN -"coord1D" ELSE "coord1D" END AS "coord1D", "coord2D", party,
  0.0 AS party_score FROM lab, m""",
    digits=5,
)
def map_slice_intercept(p):
    """Path intercepts as the static picture of a dynamic fit."""
    from ..operators import trajectory

    centres = trajectory.least_squares_paths(p.state).select(
        "legislator_id", F.col("b0_1").alias("coord1D"), F.col("b0_2").alias("coord2D")
    )
    return compare.map_slice(p.fit_b, p.roster, p.fit_a, ["100"], centres=centres)


@query(
    "points:l max_radius:d outside:l",
    """SELECT count(*) AS points, max(r) AS max_radius, count(*) FILTER (WHERE r > 1.0 + 1e-9) AS outside
FROM (SELECT sqrt("coord1D" * "coord1D" + "coord2D" * "coord2D") AS r FROM fit_b WHERE period = 4)""",
)
def slice_out_of_ball(p):
    return compare.ball_report(p.fit_b.where("period = 4"))


@query(
    "party:s members:l mean1:d mean2:d",
    """SELECT CAST(party AS VARCHAR) AS party, count(*) AS members, avg("coord1D") AS mean1, avg("coord2D") AS mean2
FROM fit_a JOIN roster USING (legislator_id) GROUP BY party""",
    digits=11,
)
def party_means(p):
    return compare.party_means(compare.with_party(p.fit_a, p.roster))


@query(
    "legislator_id:l coord1D:d coord2D:d",
    """SELECT legislator_id, avg("coord1D") AS "coord1D", avg("coord2D") AS "coord2D" FROM fit_a GROUP BY 1""",
    digits=11,
)
def career_mean(p):
    return compare.career_mean(p.fit_a)


COUNTS = "c AS (SELECT legislator_id, count(*) AS votes FROM valid_votes GROUP BY 1)"
BIN = """CASE WHEN votes <= 24 THEN '1-24' WHEN votes <= 49 THEN '25-49' WHEN votes <= 99 THEN '50-99'
  WHEN votes <= 199 THEN '100-199' ELSE '200+' END"""


@query(
    "vote_bin:s members:l mean_votes:d mean_displacement:d median_displacement:d max_displacement:d",
    f"""WITH {_align(None)}, {COUNTS} SELECT {BIN} AS vote_bin, count(*) AS members, avg(votes) AS mean_votes,
  avg(displacement) AS mean_displacement, median(displacement) AS median_displacement,
  max(displacement) AS max_displacement FROM aligned JOIN c USING (legislator_id) GROUP BY 1""",
)
def vote_bins(p):
    counts = p.valid_votes.groupBy("legislator_id").agg(F.count("*").alias("votes"))
    return compare.displacement_by_bin(aligned(p), counts)


ALWAYS = """al AS (SELECT legislator_id FROM placements GROUP BY 1
  HAVING count(*) = (SELECT count(DISTINCT period) FROM placements))"""


@query(
    "legislator_id:l swing:d",
    f"""WITH {ALWAYS} SELECT legislator_id, max("coord1D") - min("coord1D") AS swing
FROM fit_a SEMI JOIN al USING (legislator_id) GROUP BY 1""",
)
def period_swing(p):
    return compare.period_swing(p.fit_a, compare.always_present(p.placements))


@query(
    "legislator_id:l mean1:d side:s",
    f"""WITH {ALWAYS}, m AS (SELECT legislator_id, avg("coord1D") AS mean1
  FROM fit_a SEMI JOIN al USING (legislator_id) GROUP BY 1)
SELECT * FROM (SELECT *, 'low' AS side FROM m ORDER BY mean1, legislator_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT *, 'high' FROM m ORDER BY mean1 DESC, legislator_id DESC LIMIT 3)""",
    digits=11,
)
def anchors(p):
    return compare.anchors(p.fit_a, compare.always_present(p.placements))


@query(
    "legislator_id:l first:d last:d drift:d",
    f"""WITH {ALWAYS}, f AS (SELECT * FROM fit_a SEMI JOIN al USING (legislator_id))
SELECT legislator_id, arg_min("coord1D", period) AS first, arg_max("coord1D", period) AS last,
  arg_max("coord1D", period) - arg_min("coord1D", period) AS drift FROM f GROUP BY 1""",
)
def anchor_drift(p):
    return compare.drift(p.fit_a, compare.always_present(p.placements))


@query(
    "matched:l r1:d r2:d",
    f"""WITH {MATCHED} SELECT count(*) AS matched, corr(a1, b1) AS r1, corr(a2, -b2) AS r2 FROM matched""",
)
def seed_stability(p):
    """Correlation of two fits from different starts after fixing the gauge."""
    second = compare.orient_dim2(p.fit_b, p.fit_a)
    return compare.join_fits(p.fit_a, second).agg(
        F.count("*").alias("matched"),
        F.corr("a1", "b1").alias("r1"),
        F.corr("a2", "b2").alias("r2"),
    )


AFTER = f"""after_star AS (
  SELECT v.legislator_id, v.period, v.rollcall_id, v.vote, s.x1, s.x2, b.z1, b.z2, b.d1, b.d2
  FROM valid_votes v JOIN state s USING (legislator_id, period)
  JOIN (SELECT n.* FROM bills_b n JOIN bills o USING (rollcall_id) WHERE o.valid) b USING (rollcall_id)),
after_scored AS ({scored_from('SELECT * FROM after_star')})"""


@query(
    "ll_a:d ll_b:d ll_difference:d objective_equivalent:i parameter_equivalent:i equivalent:i a_is_better:i",
    f"""WITH {AFTER}, l AS (SELECT (SELECT sum(ll) FROM scored) AS ll_a, (SELECT sum(ll) FROM after_scored) AS ll_b),
d AS (SELECT max(greatest(abs(a.z1 - b.z1), abs(a.z2 - b.z2), abs(a.d1 - b.d1))) AS m
  FROM bills a JOIN bills_b b USING (rollcall_id))
SELECT ll_a, ll_b, ll_a - ll_b AS ll_difference, CAST(abs(ll_a - ll_b) <= 1e-6 AS INTEGER) AS objective_equivalent,
  CAST(m <= 1e-6 AS INTEGER) AS parameter_equivalent,
  CAST(m <= 1e-6 AND abs(ll_a - ll_b) <= 1e-6 AS INTEGER) AS equivalent,
  CAST(ll_a - ll_b > 1e-6 AS INTEGER) AS a_is_better FROM l, d""",
    digits=4,
)
def equivalence_verdict(p):
    valid = p.bills.where("valid").select("rollcall_id", "valid")
    second = scoring.score(
        scoring.star_join(p.valid_votes, p.state, p.bills_b.join(valid, "rollcall_id")),
        TRUE_WEIGHTS,
    )
    gap = compare.max_component_difference(
        p.bills, p.bills_b, ["rollcall_id"], ["z1", "z2", "d1", "d2"]
    )
    return compare.equivalence(
        scoring.log_likelihood(p.scored), scoring.log_likelihood(second), gap
    )


@query(
    "metric:s low:d high:d value:d passed:i",
    f"""WITH {_align('period')}, s AS (SELECT period, {SCORES} FROM aligned GROUP BY period),
ll AS (SELECT sum(ll) AS l, count(*) FILTER (WHERE correct) * 100.0 / count(*) AS c FROM scored),
m AS (SELECT 'log_likelihood' AS metric, l AS value FROM ll
  UNION ALL SELECT 'classification_pct', c FROM ll
  UNION ALL SELECT 'r1_period_' || period, r1 FROM s UNION ALL SELECT 'scale2_period_' || period, scale2 FROM s),
e AS (SELECT 'log_likelihood' AS metric, -1e9 AS low, 0.0 AS high UNION ALL SELECT 'classification_pct', 90.0, NULL
  UNION ALL SELECT 'r1_period_' || i, 0.99, NULL FROM range(1, 8) t(i)
  UNION ALL SELECT 'scale2_period_' || i, 0.7, 1.0 FROM range(1, 8) t(i)
  UNION ALL SELECT 'absent_metric', 0.0, NULL)
SELECT metric, low, high, value, CAST(value IS NOT NULL AND coalesce(value >= low, true)
  AND coalesce(value <= high, true) AS INTEGER) AS passed FROM e LEFT JOIN m USING (metric)""",
    digits=4,
)
def panel_gates(p):
    overall = scoring.log_likelihood(p.scored)
    by_period = compare.scores(aligned(p, ["period"]), ["period"])
    stack = F.inline(
        F.array(
            *[
                F.struct(
                    F.concat(F.lit(f"{m}_period_"), F.col("period").cast("string")).alias("metric"),
                    F.col(m).alias("value"),
                )
                for m in ("r1", "scale2")
            ]
        )
    )
    whole = F.inline(
        F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                for m in ("log_likelihood", "classification_pct")
            ]
        )
    )
    metrics = overall.select(whole).unionByName(by_period.select(stack))
    rows = [("log_likelihood", -1e9, 0.0), ("classification_pct", 90.0, None), ("absent_metric", 0.0, None)]
    rows += [(f"r1_period_{i}", 0.99, None) for i in range(1, 8)]
    rows += [(f"scale2_period_{i}", 0.7, 1.0) for i in range(1, 8)]
    expected = p.spark.createDataFrame(rows, "metric string, low double, high double")
    return compare.gates(metrics, expected)


@query(
    "max_coordinate_radius:d max_midpoint_radius:d coordinates_feasible:i midpoints_feasible:i",
    """SELECT mc AS max_coordinate_radius, mm AS max_midpoint_radius,
  CAST(mc <= 1.0 + 1e-12 AS INTEGER) AS coordinates_feasible, CAST(mm <= 1.0 + 1e-12 AS INTEGER) AS midpoints_feasible
FROM (SELECT (SELECT max(sqrt("coord1D" * "coord1D" + "coord2D" * "coord2D")) FROM fit_a) AS mc,
  (SELECT max(sqrt(z1 * z1 + z2 * z2)) FROM bills) AS mm)""",
)
def geometry_audit(p):
    return audit.geometry(p.fit_a, p.bills)
