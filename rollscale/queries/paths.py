"""Served grids, paths and rebuilt positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trajectory
from ..functions import trend
from ..sources import sinks
from .catalog import query

GRID = """g AS (SELECT *, CASE WHEN served > 1 THEN (k - 1) * (2.0::DOUBLE / (served - 1)) - 1.0
    ELSE -1.0 END AS t
  FROM (SELECT legislator_id, period, x1, x2,
    row_number() OVER (PARTITION BY legislator_id ORDER BY period) AS k,
    count(*) OVER (PARTITION BY legislator_id) AS served FROM state)),
basis AS (SELECT *, (3 * t * t - 1) / 2.0 AS p2, (5 * t * t * t - 3 * t) / 2.0 AS p3 FROM g)"""


def _paths_sql(model: int = 3) -> str:
    """Least squares from the normal equations of each order, by tenure."""
    cols = []
    for k in (1, 2):
        x = f"x{k}"
        cols.append(
            f"""CASE WHEN ord = 0 THEN first{k} WHEN ord = 1 THEN y0_{k} / n
      ELSE (y0_{k} * q22 - y2_{k} * q2) / (n * q22 - q2 * q2) END AS b0_{k},
    CASE WHEN ord = 0 THEN 0.0 WHEN ord < 3 THEN y1_{k} / q11
      ELSE (y1_{k} * q33 - y3_{k} * q13) / (q11 * q33 - q13 * q13) END AS b1_{k},
    CASE WHEN ord < 2 THEN 0.0 ELSE (n * y2_{k} - q2 * y0_{k}) / (n * q22 - q2 * q2) END AS b2_{k},
    CASE WHEN ord < 3 THEN 0.0
      ELSE (q11 * y3_{k} - q13 * y1_{k}) / (q11 * q33 - q13 * q13) END AS b3_{k}"""
        )
    sums = ", ".join(
        f"sum(x{k}) AS y0_{k}, sum(x{k} * t) AS y1_{k}, sum(x{k} * p2) AS y2_{k}, "
        f"sum(x{k} * p3) AS y3_{k}, arg_min(x{k}, k) AS first{k}"
        for k in (1, 2)
    )
    return f"""{GRID},
paths AS (SELECT legislator_id, served, eff_order, {', '.join(cols)}
  FROM (SELECT *, CAST(CASE WHEN served >= 7 THEN 3 WHEN served = 6 THEN 2 WHEN served = 5 THEN 1
      ELSE 0 END AS INTEGER) AS ord,
    CAST(least({model}, CASE WHEN served >= 7 THEN 3 WHEN served = 6 THEN 2 WHEN served = 5 THEN 1
      ELSE 0 END) AS INTEGER) AS eff_order
    FROM (SELECT legislator_id, max(served) AS served, count(*)::DOUBLE AS n, sum(t * t) AS q11,
      sum(p2) AS q2, sum(p2 * p2) AS q22, sum(t * p3) AS q13, sum(p3 * p3) AS q33, {sums}
      FROM basis GROUP BY legislator_id)))"""


PATHS = "WITH " + _paths_sql()
BETAS = " ".join(f"b{j}_{k}:d" for j in range(4) for k in (1, 2))


def _at(k: int) -> str:
    return (
        f"b0_{k} + CASE WHEN eff_order >= 1 THEN b1_{k} * t ELSE 0.0 END"
        f" + CASE WHEN eff_order >= 2 THEN b2_{k} * (3 * t * t - 1) / 2.0 ELSE 0.0 END"
        f" + CASE WHEN eff_order >= 3 THEN b3_{k} * (5 * t * t * t - 3 * t) / 2.0 ELSE 0.0 END"
    )


@query(
    "legislator_id:l period:i k:i served:i",
    f"WITH {GRID} SELECT * FROM g",
)
def served_index(p):
    return trajectory.served_index(p.placements)


@query(
    "legislator_id:l period:i t:d p2:d p3:d",
    f"WITH {GRID} SELECT * FROM basis",
)
def legendre_basis(p):
    return trajectory.served_grid(p.placements)


@query(
    "legislator_id:l served:i order1:i order3:i",
    f"""WITH {GRID} SELECT legislator_id, served, least(1, o) AS order1, o AS order3
FROM (SELECT legislator_id, max(served) AS served, CASE WHEN max(served) >= 7 THEN 3
  WHEN max(served) = 6 THEN 2 WHEN max(served) = 5 THEN 1 ELSE 0 END AS o FROM g GROUP BY 1)""",
)
def effective_order(p):
    tenure = p.placements.groupBy("legislator_id").agg(F.count("*").cast("int").alias("served"))
    return tenure.select(
        "legislator_id",
        "served",
        trend.effective_order(F.col("served"), 1).alias("order1"),
        trend.effective_order(F.col("served"), 3).alias("order3"),
    )


@query(
    f"legislator_id:l served:i eff_order:i {BETAS}",
    PATHS + " SELECT * FROM paths",
)
def trajectory_ols(p):
    return trajectory.least_squares_paths(p.state)


@query(
    f"legislator_id:l served:i eff_order:i {BETAS}",
    "WITH " + _paths_sql(1) + " SELECT * FROM paths",
)
def trajectory_recover(p):
    """Coefficients from stored positions, order capped by a linear model."""
    return trajectory.start_paths(p.state, 1)


@query(
    "legislator_id:l period:i x1:d x2:d eff_order:i",
    PATHS
    + f""" SELECT legislator_id, period, {_at(1)} AS x1, {_at(2)} AS x2, eff_order
FROM g JOIN paths USING (legislator_id)""".replace("SELECT legislator_id, period", "SELECT legislator_id, period"),
)
def reconstruct_positions(p):
    return trajectory.reconstruct(trajectory.least_squares_paths(p.state), p.placements)


@query(
    "legislator_id:l period:i x1:d x2:d",
    PATHS
    + f""" SELECT legislator_id, period, {_at(1)} AS x1, {_at(2)} AS x2
FROM (SELECT *, -1.0 + 2.0::DOUBLE * (period - 1) / 6 AS t FROM paths, range(1, 8) AS r(period))""",
)
def reconstruct_global_grid(p):
    return trajectory.reconstruct_calendar(trajectory.least_squares_paths(p.state), 7)


@query(
    "legislator_id:l served:i mean1:d path_mean1:d mean2:d path_mean2:d",
    PATHS
    + """ SELECT legislator_id, served, mean1, mean2,
  b0_1 + CASE WHEN served > 1 THEN b2_1 / (served - 1) ELSE 0.0 END AS path_mean1,
  b0_2 + CASE WHEN served > 1 THEN b2_2 / (served - 1) ELSE 0.0 END AS path_mean2
FROM paths JOIN (SELECT legislator_id, avg(x1) AS mean1, avg(x2) AS mean2 FROM state GROUP BY 1)
USING (legislator_id)""",
)
def mean_identity(p):
    return trajectory.mean_identity(p.state, trajectory.least_squares_paths(p.state))


@query(
    "members:l max_intercept_radius:d max_mean_radius:d max_position_radius:d "
    "intercepts_outside:l means_outside:l positions_outside:l",
    PATHS
    + """ SELECT count(*) AS members, max(sqrt(b0_1 * b0_1 + b0_2 * b0_2)) AS max_intercept_radius,
  max(sqrt(m1 * m1 + m2 * m2)) AS max_mean_radius,
  (SELECT max(sqrt(x1 * x1 + x2 * x2)) FROM state) AS max_position_radius,
  count(*) FILTER (WHERE sqrt(b0_1 * b0_1 + b0_2 * b0_2) > 1.0 + 1e-9) AS intercepts_outside,
  count(*) FILTER (WHERE sqrt(m1 * m1 + m2 * m2) > 1.0 + 1e-9) AS means_outside,
  (SELECT count(*) FROM state WHERE sqrt(x1 * x1 + x2 * x2) > 1.0 + 1e-9) AS positions_outside
FROM paths JOIN (SELECT legislator_id, avg(x1) AS m1, avg(x2) AS m2 FROM state GROUP BY 1)
USING (legislator_id)""",
)
def temporal_centre_audit(p):
    return trajectory.centre_audit(p.state, trajectory.least_squares_paths(p.state))


@query(
    "legislator_id:l served_periods:i effective_model:i beta0_dim1:d beta1_dim2:d beta2_dim1:d "
    "beta3_dim2:d intercept_radius:d",
    PATHS
    + """ SELECT legislator_id, served AS served_periods, eff_order AS effective_model,
  b0_1 AS beta0_dim1, b1_2 AS beta1_dim2, b2_1 AS beta2_dim1, b3_2 AS beta3_dim2,
  sqrt(b0_1 * b0_1 + b0_2 * b0_2) AS intercept_radius FROM paths""",
)
def export_coefficients(p):
    from .readers import round_trip

    table = sinks.coefficients(trajectory.least_squares_paths(p.state))
    return round_trip(p, table, "coefficients")
