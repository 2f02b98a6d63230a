"""Audits of traces, stored geometry, phases and presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..functions.ball import radius
from .running import LIMITS, order_statistics
from .totals import with_totals

TRACE_COLUMNS = (
    "attempted",
    "accepted",
    "raw_return_feasible",
    "constraint_tolerance",
    "raw_constraint_violation",
    "improvement",
    "infeasible_objective_evaluations",
    "max_objective_constraint_violation",
)


def require_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def trace_rollup(trace: DataFrame, *by: str, tolerance: float = 1e-9) -> DataFrame:
    """Attempts, outcomes and violations; the two last columns must be zero."""
    trace = require_columns(trace, TRACE_COLUMNS)
    tried = F.col("attempted") == 1
    kept = tried & (F.col("accepted") == 1)
    bad = F.col("infeasible_objective_evaluations")
    return trace.groupBy(*by).agg(
        F.count_if(tried).alias("attempted_blocks"),
        F.count_if(~tried).alias("skipped_blocks"),
        F.count_if(kept).alias("accepted_blocks"),
        F.count_if(tried & (F.col("accepted") == 0)).alias("rejected_blocks"),
        F.count_if(tried & (F.col("raw_return_feasible") == 0)).alias("outside_tolerance"),
        F.coalesce(F.sum(F.when(tried, bad)), F.lit(0)).alias("infeasible_evaluations"),
        F.max(F.when(tried, F.col("max_objective_constraint_violation"))).alias(
            "max_objective_violation"
        ),
        F.max(F.when(tried, F.col("raw_constraint_violation"))).alias("max_return_violation"),
        F.count_if(tried & (F.col("numerical_correction_applied") == 1)).alias("corrections"),
        F.count_if(
            kept
            & (
                (F.col("raw_return_feasible") != 1)
                | (
                    F.col("raw_constraint_violation")
                    > F.col("constraint_tolerance") + 1e-18
                )
            )
        ).alias("accepted_infeasible"),
        F.count_if(kept & (F.col("improvement") < -tolerance)).alias("accepted_decreases"),
    )


def check_trace(trace: DataFrame, tolerance: float = 1e-9) -> dict:
    """Roll-up of a whole trace; raises on a broken acceptance contract."""
    row = trace_rollup(trace, tolerance=tolerance).first().asDict()
    if row["accepted_infeasible"]:
        raise ValueError("an infeasible return was accepted")
    if row["accepted_decreases"]:
        raise ValueError("an accepted block decreased the likelihood")
    return row


def geometry(coords: DataFrame, bills: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Largest radius of stored coordinates and midpoints, and whether both hold."""
    zero = F.lit(0.0)
    mid = radius(F.coalesce("z1", zero), F.coalesce("z2", zero))
    limit = 1.0 + tolerance
    positions = coords.agg(
        F.max(radius(F.col("coord1D"), F.col("coord2D"))).alias("max_coordinate_radius")
    )
    midpoints = bills.agg(F.max(mid).alias("max_midpoint_radius"))
    return with_totals(positions, midpoints).withColumns(
        {
            "coordinates_feasible": (F.col("max_coordinate_radius") <= limit).cast("int"),
            "midpoints_feasible": (F.col("max_midpoint_radius") <= limit).cast("int"),
        }
    )


def radial_deciles(bills: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Nearest-rank deciles of midpoint radii, rim count and largest radius.

    Roll calls whose parameters are all exactly zero were not fitted and are left out.
    """
    zero = (F.col("z1") == 0) & (F.col("z2") == 0) & (F.col("d1") == 0) & (F.col("d2") == 0)
    fitted = bills.where(~zero).select(
        F.sqrt(F.col("z1") * F.col("z1") + F.col("z2") * F.col("z2")).alias("r")
    )

    def deciles(n):
        return {
            f"decile{d}": F.least(n - 1, F.floor(n * d / 10)) for d in range(1, 11)
        }

    ranks = order_statistics(fitted, [], "r", deciles, limits).withColumnRenamed("n", "fitted")
    rim = fitted.agg(
        F.count_if(F.col("r") >= 0.999).alias("rim"), F.max("r").alias("max_radius")
    )
    return with_totals(ranks, rim)


def step_histogram(steps: DataFrame, value: str, limits: Limits = LIMITS) -> DataFrame:
    """Quartiles, mean and counts at the floor (<= 5) and cap (>= 50) of step counts."""
    used = steps.where(F.col(value) > 0).select(F.col(value).alias("v"))

    def quartiles(n):
        return {
            "p25": F.floor(n / 4),
            "median": F.floor(n / 2),
            "p75": F.floor(n * 3 / 4),
        }

    placed = order_statistics(used, [], "v", quartiles, limits)
    whole = used.agg(
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.avg("v").alias("mean"),
        F.count_if(F.col("v") <= 5).alias("at_floor"),
        F.count_if(F.col("v") >= 50).alias("at_cap"),
    )
    return with_totals(placed, whole)


def presence(placements: DataFrame) -> DataFrame:
    """Placements and members with more than one period."""
    per_member = placements.groupBy("legislator_id").agg(F.count("*").alias("n"))
    return per_member.agg(
        F.count("*").alias("members"),
        F.sum("n").alias("placements"),
        F.count_if(F.col("n") > 1).alias("multi_period_members"),
    )


def layout_mismatches(by_member: DataFrame, by_item: DataFrame) -> DataFrame:
    """Cells on which two copies of the votes disagree, in vote or in missingness."""
    keys = ["legislator_id", "rollcall_id"]
    left = by_member.select(*keys, F.col("vote").alias("v1"), F.lit(1).alias("l"))
    right = by_item.select(*keys, F.col("vote").alias("v2"), F.lit(1).alias("r"))
    both = left.join(right, keys, "full")
    return both.where(
        F.col("l").isNull() | F.col("r").isNull() | ~F.col("v1").eqNullSafe(F.col("v2"))
    )


def record_mismatches(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Count of disagreeing records per field of two member files, and unmatched keys."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in fields], F.lit(1).alias("_l"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in fields], F.lit(1).alias("_r"))
    both = left.join(right, keys, "full")
    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(
        F.count_if(~matched).alias("unmatched"),
        *[
            F.count_if(matched & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"{c}_differs")
            for c in fields
        ],
    )
