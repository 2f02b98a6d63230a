"""Served grids, path coefficients and positions rebuilt from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trend
from .totals import with_totals

BETA_COLUMNS = [f"b{j}_{k}" for j in range(4) for k in (1, 2)]


def served_index(placements: DataFrame) -> DataFrame:
    """k-th served period of K per member (a member has at most one row per period)."""
    member = Window.partitionBy("legislator_id")
    return placements.withColumns(
        {
            "k": F.row_number().over(member.orderBy("period")).cast("int"),
            "served": F.count("*").over(member).cast("int"),
        }
    )


def served_grid(placements: DataFrame) -> DataFrame:
    """Served index with local time and the polynomial basis."""
    df = served_index(placements).withColumn(
        "t", trend.local_time(F.col("k"), F.col("served"))
    )
    _, p1, p2, p3 = trend.legendre(F.col("t"))
    return df.withColumns({"p1": p1, "p2": p2, "p3": p3})


def least_squares_paths(
    coords: DataFrame, model: int | None = None, grid: DataFrame | None = None
) -> DataFrame:
    """Path coefficients per member from period positions x1, x2.

    On the even grid of local time the basis splits into an even and an odd pair,
    so each pair is a 2x2 system solved in closed form from sums.  Fewer than five
    served periods keep the first position only.  With `model` the order is also
    capped by it; without it the tenure alone decides.  `grid` saves the windows when
    the served grid of the coordinates is already at hand.
    """
    if grid is None:
        grid = served_grid(coords)
    else:
        grid = grid.join(coords, ["legislator_id", "period"])
    sums = [F.first("served").alias("served")]
    for a, b in (("p2", "p2"), ("p1", "p1"), ("p1", "p3"), ("p3", "p3")):
        sums.append(F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}"))
    sums.append(F.sum("p2").alias("s_p2"))
    for k in ("1", "2"):
        x = F.col(f"x{k}")
        sums += [
            F.sum(x).alias(f"y0_{k}"),
            F.sum(x * F.col("p1")).alias(f"y1_{k}"),
            F.sum(x * F.col("p2")).alias(f"y2_{k}"),
            F.sum(x * F.col("p3")).alias(f"y3_{k}"),
            F.min_by(x, F.col("k")).alias(f"first_{k}"),
        ]
    df = grid.groupBy("legislator_id").agg(*sums)
    order = trend.effective_order(F.col("served"), 3 if model is None else model)
    df = df.withColumn("eff_order", order.cast("int"))
    n = F.col("served").cast("double")
    even_det = n * F.col("s_p2p2") - F.col("s_p2") * F.col("s_p2")
    odd_det = F.col("s_p1p1") * F.col("s_p3p3") - F.col("s_p1p3") * F.col("s_p1p3")
    fit = F.col("eff_order")
    out = {}
    for k in ("1", "2"):
        y0, y1, y2, y3 = (F.col(f"y{j}_{k}") for j in range(4))
        alone_even = y0 / n
        alone_odd = y1 / F.col("s_p1p1")
        b0 = (y0 * F.col("s_p2p2") - y2 * F.col("s_p2")) / even_det
        b2 = (n * y2 - F.col("s_p2") * y0) / even_det
        b1 = (y1 * F.col("s_p3p3") - y3 * F.col("s_p1p3")) / odd_det
        b3 = (F.col("s_p1p1") * y3 - F.col("s_p1p3") * y1) / odd_det
        out[f"b0_{k}"] = (
            F.when(fit >= 2, b0).when(fit == 1, alone_even).otherwise(F.col(f"first_{k}"))
        )
        out[f"b1_{k}"] = F.when(fit == 3, b1).when(fit >= 1, alone_odd).otherwise(0.0)
        out[f"b2_{k}"] = F.when(fit >= 2, b2).otherwise(0.0)
        out[f"b3_{k}"] = F.when(fit == 3, b3).otherwise(0.0)
    return df.select("legislator_id", "served", "eff_order", *[out[c].alias(c) for c in BETA_COLUMNS])


def start_paths(coords: DataFrame, model: int, grid: DataFrame | None = None) -> DataFrame:
    """Start of a member fit: tenure-based least squares, order capped by the model."""
    full = least_squares_paths(coords, grid=grid)
    return full.withColumn(
        "eff_order", trend.effective_order(F.col("served"), model).cast("int")
    )


def _path(k: str, basis: list[Column], order: Column) -> Column:
    total = F.col(f"b0_{k}")
    for j in (1, 2, 3):
        total = total + F.when(order >= j, F.col(f"b{j}_{k}") * basis[j]).otherwise(0.0)
    return total


def reconstruct(
    paths: DataFrame,
    placements: DataFrame,
    order: Column | None = None,
    grid: DataFrame | None = None,
) -> DataFrame:
    """Positions of the served (member, period) pairs from path coefficients."""
    if grid is None:
        grid = served_grid(placements.select("legislator_id", "period"))
    columns = ["legislator_id", "eff_order", *BETA_COLUMNS]
    joined = grid.join(paths.select(*columns), "legislator_id")
    basis = [F.lit(1.0), F.col("p1"), F.col("p2"), F.col("p3")]
    order = F.col("eff_order") if order is None else order
    return joined.select(
        "legislator_id",
        "period",
        _path("1", basis, order).alias("x1"),
        _path("2", basis, order).alias("x2"),
        order.cast("int").alias("eff_order"),
        "served",
    )


def reconstruct_calendar(paths: DataFrame, periods: int) -> DataFrame:
    """Legacy option: every member at every calendar period on one global grid."""
    spread = paths.withColumn(
        "period", F.explode(F.sequence(F.lit(1), F.lit(periods)))
    ).withColumn("t", trend.calendar_time(F.col("period"), F.lit(periods)))
    basis = list(trend.legendre(F.col("t")))
    order = F.col("eff_order")
    return spread.select(
        "legislator_id",
        "period",
        _path("1", basis, order).alias("x1"),
        _path("2", basis, order).alias("x2"),
    )


def mean_identity(coords: DataFrame, paths: DataFrame) -> DataFrame:
    """Arithmetic mean of the period positions against b0 + b2 / (K - 1)."""
    means = coords.groupBy("legislator_id").agg(
        F.avg("x1").alias("mean1"), F.avg("x2").alias("mean2")
    )
    joined = paths.join(means, "legislator_id")
    out = {}
    for k in ("1", "2"):
        by_path = F.col(f"b0_{k}") + F.when(
            F.col("served") > 1, F.col(f"b2_{k}") / (F.col("served") - 1)
        ).otherwise(0.0)
        out[f"path_mean{k}"] = by_path
        out[f"gap{k}"] = F.abs(F.col(f"mean{k}") - by_path)
    return joined.withColumns(out)


def centre_audit(coords: DataFrame, paths: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Radii of intercepts, means and realised positions, and the two error maxima."""
    identity = mean_identity(coords, paths)
    rebuilt = reconstruct(paths, coords).select(
        "legislator_id", "period", F.col("x1").alias("r1"), F.col("x2").alias("r2")
    )
    moved = coords.join(rebuilt, ["legislator_id", "period"])
    members = identity.agg(
        F.max(F.hypot("b0_1", "b0_2")).alias("max_intercept_radius"),
        F.max(F.hypot("mean1", "mean2")).alias("max_mean_radius"),
        F.count_if(F.hypot("b0_1", "b0_2") > 1.0 + tolerance).alias("intercepts_outside"),
        F.count_if(F.hypot("mean1", "mean2") > 1.0 + tolerance).alias("means_outside"),
        F.max(F.when(F.col("eff_order") >= 1, F.greatest("gap1", "gap2"))).alias(
            "max_identity_error"
        ),
        F.count("*").alias("members"),
    )
    positions = moved.agg(
        F.max(F.hypot("x1", "x2")).alias("max_position_radius"),
        F.count_if(F.hypot("x1", "x2") > 1.0 + tolerance).alias("positions_outside"),
        F.max(
            F.greatest(
                F.abs(F.col("x1") - F.col("r1")), F.abs(F.col("x2") - F.col("r2"))
            )
        ).alias("max_reconstruction_error"),
    )
    return with_totals(members, positions)


def position_variance(rows: DataFrame) -> DataFrame:
    """Variance and standard error of a position at local time t."""
    out = {}
    for k in ("1", "2"):
        v = (
            F.col(f"v0_{k}")
            + F.col("t") * F.col("t") * F.col(f"v1_{k}")
            + F.col("t") * 2.0 * F.col(f"c01_{k}")
        )
        out[f"var{k}"] = v
        out[f"se{k}"] = F.sqrt(F.abs(v))
    return rows.withColumns(out)
