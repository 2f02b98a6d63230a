"""Traces over cycles and runs.  A trace holds one row per cycle and stays small;
coordinate changes work on full snapshots and are keyed, never global, windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .totals import with_totals


def _over(by: list[str] | None) -> Window:
    return Window.partitionBy(*(by or [])).orderBy("iteration")


def deltas(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    ll = F.col("log_likelihood")
    return trace.withColumn(
        "delta_log_likelihood", F.coalesce(ll - F.lag(ll).over(_over(by)), F.lit(0.0))
    )


def parameter_changes(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    return trace.withColumns(
        {f"delta_{c}": F.abs(F.col(c) - F.lag(c).over(_over(by))) for c in ("w2", "beta")}
    )


def moving_average(trace: DataFrame, width: int = 5, by: list[str] | None = None) -> DataFrame:
    frame = _over(by).rowsBetween(1 - width, 0)
    return trace.withColumns(
        {
            "ll_average": F.avg("log_likelihood").over(frame),
            "classification_average": F.avg("classification_pct").over(frame),
        }
    )


def patience(
    trace: DataFrame,
    abs_tol: float,
    rel_tol: float = 0.0,
    min_cycles: int = 2,
    needed: int = 2,
    by: list[str] | None = None,
) -> DataFrame:
    """Length of the current run of calm cycles and the first stop."""
    over = _over(by)
    previous = F.lag("log_likelihood").over(over)
    gain = F.col("log_likelihood") - previous
    threshold = abs_tol + rel_tol * F.greatest(F.lit(1.0), F.abs(previous))
    calm = F.coalesce(
        (F.col("iteration") >= min_cycles) & (gain >= 0) & (gain <= threshold), F.lit(False)
    )
    df = trace.withColumn("calm", calm)
    breaks = F.sum(F.when(F.col("calm"), 0).otherwise(1)).over(over)
    df = df.withColumn("_island", breaks)
    island = Window.partitionBy(*(by or []), "_island").orderBy("iteration")
    streak = F.sum(F.col("calm").cast("int")).over(island).cast("int")
    return df.withColumn("streak", streak).withColumn(
        "stop", (F.col("streak") >= needed).cast("int")
    ).drop("_island")


def tail_amplitude(trace: DataFrame, width: int = 5) -> DataFrame:
    """Amplitude of the last cycles, relative amplitude and its band."""
    last = trace.orderBy(F.desc("iteration")).limit(width)
    ll = F.col("log_likelihood")
    return last.agg(
        (F.max(ll) - F.min(ll)).alias("amplitude"), F.avg(ll).alias("mean_ll")
    ).withColumn(
        "relative",
        F.when(F.col("mean_ll") != 0, F.col("amplitude") / F.abs("mean_ll")).otherwise(0.0),
    ).withColumn(
        "band",
        F.when(F.col("relative") < 0.001, "stable")
        .when(F.col("relative") < 0.01, "limit cycle")
        .otherwise("oscillating"),
    )


def merge_segments(traces: DataFrame) -> DataFrame:
    """Renumber iterations over continuation segments (segment, iteration)."""
    sizes = traces.groupBy("segment").agg(F.count("*").alias("_n"))
    order = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "segment", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_offset")
    )
    return (
        traces.join(offsets, "segment")
        .withColumn("iteration", F.col("iteration") + F.col("_offset"))
        .drop("_offset")
    )


def final_segment(rows: DataFrame) -> DataFrame:
    last = rows.agg(F.max("segment").alias("segment"))
    return rows.join(F.broadcast(last), "segment", "left_semi")


def snapshot_changes(snapshots: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """L2, largest and mean absolute change against the previous run.

    A run only compares with the previous one when both hold the same keys: equally
    many rows, all of them matched.
    """
    over = Window.partitionBy(*keys).orderBy("iteration")
    df = snapshots.withColumns(
        {f"_{c}": F.lag(c).over(over) for c in columns}
        | {"_seen": F.lag("iteration").over(over) == F.col("iteration") - 1}
    )
    gaps = [F.abs(F.col(c) - F.col(f"_{c}")) for c in columns]
    matched = F.coalesce(F.col("_seen"), F.lit(False))

    def add(parts: list[Column]) -> Column:
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total

    sums = df.groupBy("iteration").agg(
        F.count("*").alias("rows"),
        F.count_if(matched).alias("matched"),
        F.sqrt(F.sum(F.when(matched, add([g * g for g in gaps])))).alias("l2"),
        F.max(F.when(matched, F.array_max(F.array(*gaps)))).alias("largest"),
        F.avg(F.when(matched, add(gaps) / len(gaps))).alias("mean"),
    )
    # One row per run.
    by_run = Window.orderBy("iteration")
    same = (F.col("rows") == F.col("matched")) & (F.col("rows") == F.lag("rows").over(by_run))
    flagged = sums.withColumn("comparable", F.coalesce(same, F.lit(False)))
    return flagged.select(
        "iteration",
        "rows",
        *[
            F.when(F.col("comparable"), F.col(c)).alias(f"change_{c}")
            for c in ("l2", "largest", "mean")
        ],
    )


def verdict(changes: DataFrame, tail: DataFrame) -> DataFrame:
    """Convergence words from the last mean change per placement and the LL band."""
    last = (
        changes.where(F.col("change_l2").isNotNull())
        .orderBy(F.desc("iteration"))
        .limit(1)
        .select((F.col("change_l2") / F.col("rows")).alias("change_per_member"))
    )
    c = F.col("change_per_member")
    return with_totals(last, tail.select("relative", "band")).withColumn(
        "verdict",
        F.when(c < 0.005, "converged").when(c < 0.02, "nearly").otherwise("not converged"),
    )


def merged_summary(segments: DataFrame, elapsed: DataFrame) -> DataFrame:
    """One row for a chain of continuation runs: cycles, total time, last likelihood."""
    whole = segments.agg(
        F.count("*").alias("iterations"),
        F.max_by("log_likelihood", F.struct("segment", "iteration")).alias("log_likelihood"),
    )
    return with_totals(whole, elapsed.agg(F.sum("elapsed_seconds").alias("elapsed")))
