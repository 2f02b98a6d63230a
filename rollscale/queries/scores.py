"""Distances to likelihood, classification, gradients and member statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ball, probit, spatial
from ..operators import audit, information, records, scoring, screens, trajectory
from ..panel import TRUE_WEIGHTS
from .base_sql import log_phi, phi, scored_from
from .catalog import query
from .cutpoints import PLANES

KEYS = "legislator_id:l rollcall_id:l"
W = TRUE_WEIGHTS


@query(f"{KEYS} vote:i x1:d x2:d z1:d z2:d d1:d d2:d",
       "SELECT * REPLACE (CAST(vote AS INTEGER) AS vote) FROM star")
def star_join(p):
    return p.star


@query(f"{KEYS} yes1:d no1:d yes2:d no2:d", "SELECT * FROM scored")
def distances(p):
    return spatial.with_distances(p.star)


@query(f"{KEYS} u_chosen:d u_other:d", "SELECT * FROM scored")
def utilities(p):
    return spatial.with_utilities(spatial.with_distances(p.star), W)


@query(f"{KEYS} zs:d", "SELECT * FROM scored")
def probit_scores(p):
    return p.scored


@query(
    f"{KEYS} ll:d cdf:d density_ratio:d gauss_ratio:d",
    f"""SELECT *, {phi('zc')} AS cdf, gauss_ratio / sqrt(2.0 * pi()) AS density_ratio
FROM (SELECT *, exp(-zs * zs / 2.0) / {phi('zc')} AS gauss_ratio FROM scored)""",
    name="log_phi",
)
def log_phi_value(p):
    return p.scored.withColumns(
        {
            "cdf": probit.phi(F.col("zs")),
            "density_ratio": probit.pdf_over_phi(F.col("zs")),
            "gauss_ratio": probit.gauss_over_phi(F.col("zs")),
        }
    )


@query(
    f"{KEYS} ll:d",
    f"""SELECT legislator_id, rollcall_id, a + (zc * 10000.0 - low) * (b - a) AS ll
FROM (SELECT *, {log_phi('(low / 10000.0)')} AS a, {log_phi('((low + 1.0) / 10000.0)')} AS b
  FROM (SELECT *, least(floor(zc * 10000.0), 49999.0)::DOUBLE AS low FROM scored))""",
)
def log_phi_table(p):
    return p.scored.withColumn("ll", probit.log_phi_linear(F.col("zs")))


@query(
    f"{KEYS} ll:d",
    f"""SELECT legislator_id, rollcall_id, {log_phi('g')} AS ll
FROM (SELECT *, sign(zs) * least(floor(abs(zs) * 10000.0 + 0.5), 49998.0)::DOUBLE / 10000.0 AS g
  FROM scored)""",
)
def log_phi_nearest(p):
    return p.scored.withColumn("ll", probit.log_phi_nearest(F.col("zs")))


@query(
    f"{KEYS} correct:i gross_error:i positive:i",
    """SELECT * REPLACE (CAST(correct AS INTEGER) AS correct,
  CAST(gross_error AS INTEGER) AS gross_error, CAST(positive AS INTEGER) AS positive) FROM scored""",
)
def vote_flags(p):
    return p.scored


COUNTERS = """sum(ll) AS log_likelihood, count(*) AS votes, count(*) FILTER (WHERE correct) AS correct,
  count(*) FILTER (WHERE vote AND correct) AS yea_correct,
  count(*) FILTER (WHERE vote AND NOT correct) AS yea_wrong,
  count(*) FILTER (WHERE NOT vote AND correct) AS nay_correct,
  count(*) FILTER (WHERE NOT vote AND NOT correct) AS nay_wrong,
  count(*) FILTER (WHERE gross_error) AS gross_errors,
  count(*) FILTER (WHERE positive) AS positive,
  exp(sum(ll) / count(*)) AS gmp, count(*) FILTER (WHERE correct) * 100.0 / count(*) AS classification_pct"""


@query(
    "log_likelihood:d votes:l gmp:d",
    f"SELECT {COUNTERS} FROM scored",
    digits=4,
)
def panel_log_likelihood(p):
    return scoring.log_likelihood(p.scored)


@query(
    "votes:l correct:l yea_correct:l yea_wrong:l nay_correct:l nay_wrong:l gross_errors:l positive:l",
    f"SELECT {COUNTERS} FROM scored",
)
def confusion(p):
    return scoring.log_likelihood(p.scored)


@query(
    "legislator_id:l log_likelihood:d votes:l gross_errors:l gmp:d",
    f"SELECT legislator_id, {COUNTERS} FROM scored GROUP BY legislator_id",
    digits=5,
)
def legislator_ll(p):
    return scoring.log_likelihood(p.scored, "legislator_id")


@query(
    "legislator_id:l period:i log_likelihood:d votes:l gross_errors:l gmp:d",
    f"SELECT legislator_id, period, {COUNTERS} FROM scored GROUP BY legislator_id, period",
    digits=5,
)
def legislator_period_stats(p):
    return scoring.log_likelihood(p.scored, "legislator_id", "period")


@query(
    "rollcall_id:l log_likelihood:d votes:l correct:l gmp:d",
    f"SELECT rollcall_id, {COUNTERS} FROM scored GROUP BY rollcall_id",
    digits=5,
)
def gmp_by_rollcall(p):
    return scoring.log_likelihood(p.scored, "rollcall_id")


BEFORE_AFTER_SQL = """WITH after_star AS (
  SELECT v.legislator_id, v.period, v.rollcall_id, v.vote, s.x1, s.x2, b.z1, b.z2, b.d1, b.d2
  FROM valid_votes v JOIN state s USING (legislator_id, period)
  JOIN (SELECT n.* FROM bills_b n JOIN bills o USING (rollcall_id) WHERE o.valid) b USING (rollcall_id)),
after_scored AS (%s)"""


def _after_sql() -> str:
    return BEFORE_AFTER_SQL % scored_from("SELECT * FROM after_star")


def _after(p):
    """The same votes scored with the second set of roll-call parameters."""
    valid = p.bills.where("valid").select("rollcall_id", "valid")
    bills = p.bills_b.join(valid, "rollcall_id")
    return scoring.score(scoring.star_join(p.valid_votes, p.state, bills), W)


@query(
    "before_pct:d after_pct:d votes:l",
    _after_sql()
    + """ SELECT (SELECT count(*) FILTER (WHERE correct) * 100.0 / count(*) FROM scored) AS before_pct,
  count(*) FILTER (WHERE correct) * 100.0 / count(*) AS after_pct, count(*) AS votes FROM after_scored""",
)
def classification_pct(p):
    return records.classification_change(p.scored, _after(p))


@query(
    "classification_pct:d",
    """SELECT round(100.0 * sum(a) / sum(b), 3) AS classification_pct FROM (
  SELECT count(*) FILTER (WHERE correct) AS a, count(*) AS b FROM scored GROUP BY legislator_id)""",
    digits=3,
)
def stored_class_pct(p):
    return scoring.stored_class_pct(scoring.log_likelihood(p.scored, "legislator_id"))


@query(
    "minority:l errors:l apre:d",
    """SELECT sum(minority) AS minority, sum(errors) AS errors,
  (sum(minority) - sum(errors))::DOUBLE / sum(minority) AS apre
FROM (SELECT rollcall_id, least(yea, nay) AS minority FROM bills WHERE valid)
LEFT JOIN (SELECT rollcall_id, count(*) FILTER (WHERE NOT correct) AS errors FROM scored GROUP BY 1)
USING (rollcall_id)""",
)
def apre(p):
    return scoring.apre(p.scored, p.bills)


@query(
    "rollcall_id:l gz1:d gz2:d gd1:d gd2:d votes:l",
    """SELECT rollcall_id, sum(gz1) AS gz1, sum(gz2) AS gz2, sum(gd1) AS gd1, sum(gd2) AS gd2,
  count(*) AS votes FROM derived GROUP BY rollcall_id""",
)
def rollcall_gradient(p):
    terms = spatial.with_derivatives(p.scored, W)
    return scoring.gradients(terms, "rollcall_id", ("gz1", "gz2", "gd1", "gd2"))


@query(
    "legislator_id:l g0_1:d g0_2:d g1_1:d g1_2:d g2_1:d g2_2:d g3_1:d g3_2:d votes:l",
    """WITH k AS (SELECT legislator_id, period,
    row_number() OVER (PARTITION BY legislator_id ORDER BY period) AS k,
    count(*) OVER (PARTITION BY legislator_id) AS n FROM placements),
t AS (SELECT legislator_id, period,
  CASE WHEN n > 1 THEN (k - 1) * (2.0::DOUBLE / (n - 1)) - 1.0 ELSE -1.0 END AS t FROM k)
SELECT legislator_id, sum(gx1) AS g0_1, sum(gx2) AS g0_2, sum(t * gx1) AS g1_1, sum(t * gx2) AS g1_2,
  sum((3 * t * t - 1) / 2.0 * gx1) AS g2_1, sum((3 * t * t - 1) / 2.0 * gx2) AS g2_2,
  sum((5 * t * t * t - 3 * t) / 2.0 * gx1) AS g3_1, sum((5 * t * t * t - 3 * t) / 2.0 * gx2) AS g3_2,
  count(*) AS votes
FROM derived JOIN t USING (legislator_id, period) GROUP BY legislator_id""",
)
def legislator_gradient(p):
    terms = spatial.with_derivatives(p.scored, W)
    return records.path_gradients(terms, trajectory.served_grid(p.placements))


INFO = """SELECT legislator_id, sum(gx1 * gx1) AS i11, sum(gx1 * gx2) AS i12,
  sum(gx2 * gx2) AS i22, count(*) AS votes FROM derived GROUP BY legislator_id"""


@query("legislator_id:l i11:d i12:d i22:d votes:l", INFO, digits=5)
def information_matrix(p):
    return scoring.information(spatial.with_derivatives(p.scored, W))


@query(
    "legislator_id:l v11:d v12:d v22:d",
    f"""SELECT legislator_id,
  f1 * p11 + f2 * (1.0 - p11) AS v11, (f1 - f2) * p12 AS v12, f1 * (1.0 - p11) + f2 * p11 AS v22
FROM (SELECT *, CASE WHEN abs(e1) > 1e-4 THEN 1.0 / e1 ELSE 0.0 END AS f1,
    CASE WHEN abs(e2) > 1e-4 THEN 1.0 / e2 ELSE 0.0 END AS f2,
    CASE WHEN e1 > e2 THEN (i11 - e2) / (e1 - e2) ELSE 1.0 END AS p11,
    CASE WHEN e1 > e2 THEN i12 / (e1 - e2) ELSE 0.0 END AS p12
  FROM (SELECT *, (i11 + i22) / 2.0 + gap AS e1, (i11 + i22) / 2.0 - gap AS e2
    FROM (SELECT *, sqrt((i11 - i22) * (i11 - i22) / 4.0 + i12 * i12) AS gap FROM ({INFO}))))""",
)
def covariance_2x2(p):
    return scoring.covariance_2x2(scoring.information(spatial.with_derivatives(p.scored, W)))


@query(
    "legislator_id:l grid1:d grid2:d log_likelihood:d votes:l",
    """WITH g AS (SELECT i / 10.0::DOUBLE AS grid1, j / 10.0::DOUBLE AS grid2
  FROM range(-10, 11) a(i), range(-10, 11) b(j) WHERE i * i + j * j < 100),
low AS (SELECT legislator_id FROM (%s) GROUP BY 1 HAVING exp(sum(ll) / count(*)) < 0.5),
tried AS (SELECT s.legislator_id, s.rollcall_id, s.vote, g.grid1 AS x1, g.grid2 AS x2,
    s.z1, s.z2, s.d1, s.d2, g.grid1, g.grid2 FROM star s SEMI JOIN low USING (legislator_id), g),
sc AS (%s),
total AS (SELECT legislator_id, grid1, grid2, round(sum(ll), 7) AS log_likelihood, count(*) AS votes
  FROM sc GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY legislator_id
  ORDER BY log_likelihood DESC, grid1, grid2) AS n FROM total) WHERE n = 1"""
    % (scored_from("SELECT * REPLACE (-x1 AS x1) FROM star"), scored_from("SELECT * FROM tried")),
    digits=4,
)
def grid_rescue(p):
    """Members who start on the wrong side of the first axis."""
    turned = p.star.withColumn("x1", -F.col("x1"))
    return records.rescue_grid(p.star, scoring.score(turned, W), W)


def _path_sql(model: int) -> str:
    """Cells of the information matrix of every path, and its inverse by elimination."""
    return f"""WITH RECURSIVE k AS (SELECT legislator_id, period, x1, x2,
    row_number() OVER (PARTITION BY legislator_id ORDER BY period) AS k,
    count(*) OVER (PARTITION BY legislator_id) AS n FROM state),
t AS (SELECT *, least({model}, CASE WHEN n >= 7 THEN 3 WHEN n >= 6 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END)
    AS eff_order, CASE WHEN n > 1 THEN (k - 1) * (2.0::DOUBLE / (n - 1)) - 1.0 ELSE -1.0 END AS t FROM k),
x AS (SELECT legislator_id, eff_order, [gx1, gx2, t * gx1, t * gx2,
    (3 * t * t - 1) / 2.0 * gx1, (3 * t * t - 1) / 2.0 * gx2,
    (5 * t * t * t - 3 * t) / 2.0 * gx1, (5 * t * t * t - 3 * t) / 2.0 * gx2] AS x
  FROM derived JOIN t USING (legislator_id, period)),
info AS (SELECT legislator_id, eff_order, i, j, sum(x[i] * x[j]) AS value
  FROM x, range(1, 9) AS a(i), range(1, 9) AS b(j)
  WHERE i <= 2 * (eff_order + 1) AND j <= 2 * (eff_order + 1) GROUP BY ALL),
swept AS (
  SELECT legislator_id, eff_order, 0 AS step, i,
    list_concat(list(value ORDER BY j), list(CASE WHEN i = j THEN 1.0 ELSE 0.0 END ORDER BY j)) AS v
  FROM info GROUP BY legislator_id, eff_order, i
  UNION ALL
  SELECT legislator_id, eff_order, step + 1, i,
    CASE WHEN i = step + 1 THEN list_transform(v, lambda y: y / top[step + 1])
      ELSE list_transform(v, lambda y, c: y - v[step + 1] * top[c] / top[step + 1]) END
  FROM (SELECT *, any_value(v) FILTER (WHERE i = step + 1) OVER (PARTITION BY legislator_id) AS top
    FROM swept WHERE step < 2 * (eff_order + 1))),
cov AS (SELECT legislator_id, eff_order, i, v[2 * (eff_order + 1) + 1:] AS row
  FROM swept WHERE step = 2 * (eff_order + 1)),
regular AS (SELECT legislator_id FROM cov GROUP BY 1 HAVING sum(row[i]) > 0 AND sum(row[i]) < {REGULAR!r})"""


#: Largest trace of an inverse that is compared: its least eigenvalue is then far above the floor,
#: so that inverse and pseudo-inverse are the same.
REGULAR = 1000.0


def _path_covariance(p, order):
    terms = spatial.with_derivatives(p.scored, W)
    info = information.path_information(terms, trajectory.served_grid(p.placements), order)
    return information.path_covariance(info, order)


def _regular(covariance, order):
    places = [information.packed_place(i, i, 2 * (order + 1)) for i in range(2 * (order + 1))]
    trace = " + ".join(f"covariance[{place}]" for place in places)
    return covariance.where(f"rank = 2 * (eff_order + 1) AND {trace} < {REGULAR!r}D")


@query(
    "legislator_id:l eff_order:i votes:l i:i j:i value:d",
    _path_sql(3)
    + """ SELECT legislator_id, eff_order, votes, i, j, value
FROM info JOIN (SELECT legislator_id, count(*) AS votes FROM x GROUP BY 1) USING (legislator_id)
WHERE i <= j""",
    digits=5,
)
def path_information(p):
    """Information matrices of paths up to cubic ones, cell by cell."""
    terms = spatial.with_derivatives(p.scored, W)
    info = information.path_information(terms, trajectory.served_grid(p.placements), 3)
    return information.cells(info, "information", 3)


@query(
    "legislator_id:l eff_order:i i:i j:i value:d",
    _path_sql(3)
    + """ SELECT legislator_id, eff_order, i, j, row[j] AS value
FROM cov SEMI JOIN regular USING (legislator_id), range(1, 9) AS b(j)
WHERE i <= j AND j <= 2 * (eff_order + 1)""",
)
def path_covariance(p):
    """Covariance of the coefficients of every path with a regular matrix, cell by cell."""
    return information.cells(_regular(_path_covariance(p, 3), 3), "covariance", 3)


#: Standard errors of positions from the covariance of linear paths.
POSITION_SE = (
    _path_sql(1)
    + """, m AS (SELECT legislator_id, max(eff_order) AS q, max(row[1]) FILTER (WHERE i = 1) AS v0_1,
    max(row[2]) FILTER (WHERE i = 2) AS v0_2, coalesce(max(row[3]) FILTER (WHERE i = 3), 0) AS v1_1,
    coalesce(max(row[4]) FILTER (WHERE i = 4), 0) AS v1_2,
    coalesce(max(row[3]) FILTER (WHERE i = 1), 0) AS c01_1,
    coalesce(max(row[4]) FILTER (WHERE i = 2), 0) AS c01_2
  FROM cov SEMI JOIN regular USING (legislator_id) GROUP BY 1),
v AS (SELECT legislator_id, period, x1, x2, v0_1 + t * t * v1_1 + t * 2.0 * c01_1 AS var1,
    v0_2 + t * t * v1_2 + t * 2.0 * c01_2 AS var2 FROM t JOIN m USING (legislator_id))"""
)


@query(
    "legislator_id:l period:i var1:d se1:d var2:d se2:d",
    POSITION_SE + " SELECT *, sqrt(abs(var1)) AS se1, sqrt(abs(var2)) AS se2 FROM v",
)
def position_se(p):
    moments = information.line_moments(_regular(_path_covariance(p, 1), 1), 1)
    rows = trajectory.served_grid(p.placements).join(moments, "legislator_id")
    return trajectory.position_variance(rows)


@query(
    "legislator_id:l period:i ll_before:d ll_after:d votes:l errors_before:l errors_after:l "
    "gmp_before:d gmp_after:d",
    _after_sql()
    + """ SELECT legislator_id, period, a.ll AS ll_before, b.ll AS ll_after, a.n AS votes,
  a.e AS errors_before, b.e AS errors_after, exp(a.ll / a.n) AS gmp_before, exp(b.ll / b.n) AS gmp_after
FROM (SELECT legislator_id, period, sum(ll) AS ll, count(*) AS n,
  count(*) FILTER (WHERE gross_error) AS e FROM scored GROUP BY 1, 2) a
JOIN (SELECT legislator_id, period, sum(ll) AS ll, count(*) AS n,
  count(*) FILTER (WHERE gross_error) AS e FROM after_scored GROUP BY 1, 2) b
USING (legislator_id, period)""",
    digits=5,
)
def legislator_stats(p):
    return records.member_records(p.scored, _after(p))


@query(
    "legislator_id:l period:i x1:d x2:d se1:d se2:d ll_after:d errors_after:l votes:l gmp_after:d",
    POSITION_SE.replace("WITH RECURSIVE", "WITH RECURSIVE after_rows AS (SELECT * FROM (%s)),", 1)
    % (_after_sql() + " SELECT * FROM after_scored")
    + """ SELECT legislator_id, period, x1, x2, sqrt(abs(var1)) AS se1, sqrt(abs(var2)) AS se2,
  ll AS ll_after, e AS errors_after, b.n AS votes, exp(ll / b.n) AS gmp_after
FROM v JOIN (SELECT legislator_id, period, sum(ll) AS ll, count(*) AS n,
  count(*) FILTER (WHERE gross_error) AS e FROM after_rows GROUP BY 1, 2) b
USING (legislator_id, period)""",
    digits=5,
)
def legislator_output(p):
    """The output record of a placement: position, error, fit after the phase."""
    return records.member_output(
        records.member_records(p.scored, _after(p)), p.state, position_se(p)
    )


@query(
    "rollcall_id:l yea:l nay:l correct_before:l correct_after:l gmp_before:d gmp_after:d "
    "z1_before:d z1_after:d d1_before:d d1_after:d",
    _after_sql()
    + """ SELECT rollcall_id, o.yea, o.nay, a.c AS correct_before, b.c AS correct_after,
  exp(a.ll / a.n) AS gmp_before, exp(b.ll / b.n) AS gmp_after, o.z1 AS z1_before, w.z1 AS z1_after,
  o.d1 AS d1_before, w.d1 AS d1_after
FROM bills o JOIN bills_b w USING (rollcall_id)
JOIN (SELECT rollcall_id, sum(ll) AS ll, count(*) AS n, count(*) FILTER (WHERE correct) AS c
  FROM scored GROUP BY 1) a USING (rollcall_id)
JOIN (SELECT rollcall_id, sum(ll) AS ll, count(*) AS n, count(*) FILTER (WHERE correct) AS c
  FROM after_scored GROUP BY 1) b USING (rollcall_id)""",
)
def rollcall_diagnostics(p):
    return records.item_records(p.bills, p.bills_b, p.scored, _after(p))


@query(
    "log_likelihood:d votes:l correct:l classification_pct:d w2:d beta:d fitted:l rim:l "
    "decile1:d decile5:d decile10:d max_radius:d",
    """WITH r AS (SELECT sqrt(z1 * z1 + z2 * z2) AS r, row_number() OVER (ORDER BY z1 * z1 + z2 * z2) - 1 AS k,
  count(*) OVER () AS n FROM bills WHERE valid)
SELECT (SELECT sum(ll) FROM scored) AS log_likelihood, (SELECT count(*) FROM scored) AS votes,
  (SELECT count(*) FILTER (WHERE correct) FROM scored) AS correct,
  (SELECT count(*) FILTER (WHERE correct) * 100.0 / count(*) FROM scored) AS classification_pct,
  0.5 AS w2, 6.0 AS beta, max(n) AS fitted, count(*) FILTER (WHERE r >= 0.999) AS rim,
  max(r) FILTER (WHERE k = least(n - 1, n // 10)) AS decile1,
  max(r) FILTER (WHERE k = least(n - 1, 5 * n // 10)) AS decile5,
  max(r) FILTER (WHERE k = n - 1) AS decile10, max(r) AS max_radius FROM r""",
    digits=4,
)
def phase_dump(p):
    return records.phase_state(p.scored, screens.zero_invalid(p.bills), W)


@query(
    "fitted:l rim:l max_radius:d " + " ".join(f"decile{d}:d" for d in range(1, 11)),
    "WITH r AS (SELECT sqrt(z1 * z1 + z2 * z2) AS r, row_number() OVER (ORDER BY z1 * z1 + z2 * z2) - 1"
    " AS k, count(*) OVER () AS n FROM bills) SELECT max(n) AS fitted,"
    " count(*) FILTER (WHERE r >= 0.999) AS rim, max(r) AS max_radius, "
    + ", ".join(
        f"max(r) FILTER (WHERE k = least(n - 1, {d} * n // 10)) AS decile{d}" for d in range(1, 11)
    )
    + " FROM r",
)
def radial_deciles(p):
    return audit.radial_deciles(p.bills)


@query(
    "n:l p25:d median:d p75:d least:l most:l mean:d at_floor:l at_cap:l",
    PLANES
    + """, s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n
  FROM (SELECT count(*) AS v FROM turns WHERE turn >= 0 GROUP BY rollcall_id))
SELECT max(n) AS n, max(v) FILTER (WHERE k = n // 4) AS p25, max(v) FILTER (WHERE k = n // 2) AS median,
  max(v) FILTER (WHERE k = 3 * n // 4) AS p75, min(v) AS least, max(v) AS most, avg(v) AS mean,
  count(*) FILTER (WHERE v <= 5) AS at_floor, count(*) FILTER (WHERE v >= 50) AS at_cap FROM s""",
)
def iteration_histogram(p):
    """Steps that the searches for the planes take."""
    from ..plans.planes import turns_taken
    from ..session import cut_lineage

    steps = turns_taken(p.votes, p.state).groupBy("rollcall_id").agg(F.count("*").alias("steps"))
    # The histogram reads the steps several times; the searches run once.
    return audit.step_histogram(cut_lineage(steps), "steps")


@query(
    "rollcall_id:l z1:d z2:d",
    """SELECT rollcall_id, m1 / n AS z1, m2 / n AS z2 FROM (
  SELECT rollcall_id, m1, m2, greatest(1.0::DOUBLE, sqrt(m1 * m1 + m2 * m2)) AS n FROM raw_bills)""",
)
def ball_projection(p):
    from ..panel import true_plane

    n1, n2, cut = true_plane(F.col("rollcall_id"))
    a, b = n1 * 60.0, n2 * 120.0
    raw = p.margins.select(
        "rollcall_id",
        (cut.cast("double") * a / (a * a + b * b)).alias("m1"),
        (cut.cast("double") * b / (a * a + b * b)).alias("m2"),
    )
    z1, z2 = ball.project_to_ball(F.col("m1"), F.col("m2"))
    return raw.select("rollcall_id", z1.alias("z1"), z2.alias("z2"))


@query(
    "legislator_id:l period:i x1:d x2:d",
    """SELECT legislator_id, period, x1 * f AS x1, x2 * f AS x2 FROM (SELECT legislator_id, period,
  x1 * 1.5 AS x1, x2 * 1.5 AS x2, CASE WHEN x1 * 1.5 * (x1 * 1.5) + x2 * 1.5 * (x2 * 1.5) > 1.0
  THEN 0.75 / sqrt(x1 * 1.5 * (x1 * 1.5) + x2 * 1.5 * (x2 * 1.5)) ELSE 1.0 END AS f FROM state)""",
)
def interior_start(p):
    wide = p.state.select(
        "legislator_id", "period", (F.col("x1") * 1.5).alias("x1"), (F.col("x2") * 1.5).alias("x2")
    )
    y1, y2 = ball.pull_inside(F.col("x1"), F.col("x2"))
    return wide.select("legislator_id", "period", y1.alias("x1"), y2.alias("x2"))


@query(
    "rollcall_id:l d1:d d2:d",
    """SELECT rollcall_id, CASE WHEN abs(d1) <= 0.001 THEN 0.03 ELSE d1 END AS d1,
  CASE WHEN abs(d2) <= 0.001 THEN 0.03 ELSE d2 END AS d2 FROM bills""",
)
def spread_floor(p):
    return p.bills.select(
        "rollcall_id",
        ball.floor_spread(F.col("d1")).alias("d1"),
        ball.floor_spread(F.col("d2")).alias("d2"),
    )


@query("legislator_id:l period:i r:d", "SELECT *, sqrt(x1 * x1 + x2 * x2) AS r FROM state")
def radius(p):
    return p.state.withColumn("r", ball.radius(F.col("x1"), F.col("x2")))


@query(
    "legislator_id:l period:i raw_radius:d violation:d feasible:i accepted1:d accepted2:d "
    "corrected:i correction:d",
    """SELECT legislator_id, period, r AS raw_radius, v AS violation, CAST(v <= 0.1 AS INTEGER) AS feasible,
  CASE WHEN v <= 0.1 THEN x1 / n END AS accepted1, CASE WHEN v <= 0.1 THEN x2 / n END AS accepted2,
  CAST(v <= 0.1 AND r > 1.0 AS INTEGER) AS corrected,
  CASE WHEN v <= 0.1 AND r > 1.0 THEN sqrt((x1 - x1 / n) * (x1 - x1 / n) + (x2 - x2 / n) * (x2 - x2 / n))
    ELSE 0.0 END AS correction
FROM (SELECT *, greatest(1.0::DOUBLE, r) AS n, greatest(0.0::DOUBLE, x1 * x1 + x2 * x2 - 1.0) AS v
  FROM (SELECT legislator_id, period, x1 * 1.25 AS x1, x2 * 1.25 AS x2,
    sqrt(x1 * 1.25 * (x1 * 1.25) + x2 * 1.25 * (x2 * 1.25)) AS r FROM state))""",
)
def ball_contract(p):
    wide = p.state.select(
        "legislator_id", "period", (F.col("x1") * 1.25).alias("x1"), (F.col("x2") * 1.25).alias("x2")
    )
    return wide.withColumns(ball.ball_contract(F.col("x1"), F.col("x2"), 0.1))


@query(
    "legislator_id:l period:i violation:d feasible:i accepted:d correction:d corrected:i",
    """SELECT legislator_id, period, v AS violation, CAST(v <= 0.05 AS INTEGER) AS feasible,
  CASE WHEN v <= 0.05 THEN c END AS accepted, CASE WHEN v <= 0.05 THEN abs(x1 - c) ELSE 0.0 END AS correction,
  CAST(v <= 0.05 AND abs(x1 - c) > 0 AS INTEGER) AS corrected
FROM (SELECT *, greatest(0.0::DOUBLE, -0.5 - x1, x1 - 0.5) AS v,
  greatest(-0.5::DOUBLE, least(0.5::DOUBLE, x1)) AS c FROM state)""",
)
def bound_contract(p):
    return p.state.withColumns(ball.bound_contract(F.col("x1"), -0.5, 0.5, 0.05))


@query(
    "log_likelihood:d votes:l correct:l gmp:d classification_pct:d",
    f"SELECT {COUNTERS} FROM scored",
    digits=4,
)
def evaluate_only(p):
    from ..plans.loop import evaluate

    return evaluate(p.votes, p.state, p.bills, W)


@query(
    "log_likelihood:d votes:l correct:l",
    f"SELECT {COUNTERS} FROM scored",
    digits=4,
)
def state_rejoin(p):
    """Saved coordinates and local-id roll calls joined back and scored."""
    from ..operators import seeds
    from ..plans.loop import evaluate
    from ..sources import sinks

    stored = sinks.reloadable_bills(p.bills).select(
        "session", "ID", *[F.col(c).alias(a) for a, c in sinks._BILL.items()]
    )
    offsets = seeds.period_offsets(p.margins)
    mapped = seeds.bill_ids(stored, offsets).select("session", "ID", "z1", "z2", "d1", "d2")
    # Local ids count the roll calls of a period, so they lead back to the panel's ids.
    numbered = sinks.local_ids(p.bills.select("rollcall_id", "period"))
    back = mapped.join(
        numbered.select(F.col("period").alias("session"), F.col("local_id").alias("ID"), "rollcall_id"),
        ["session", "ID"],
    )
    state = seeds.rejoin_state(p.placements, p.fit_a)
    return evaluate(p.votes, state, back, W)
