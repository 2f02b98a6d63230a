"""Counts, screens, placements, dedup and range filters on long votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import votes as V


def drop_missing(votes: DataFrame) -> DataFrame:
    return votes.where(F.col("vote").isNotNull())


def margins(votes: DataFrame) -> DataFrame:
    """Yea, nay, missing, minority and minority share per roll call."""
    counted = votes.groupBy("rollcall_id", "period").agg(
        F.count_if(F.col("vote")).alias("yea"),
        F.count_if(~F.col("vote")).alias("nay"),
        F.count_if(F.col("vote").isNull()).alias("missing"),
    )
    total = F.col("yea") + F.col("nay")
    return counted.withColumns(
        {
            "total": total,
            "minority": F.least("yea", "nay"),
            "margin": F.when(total > 0, F.least("yea", "nay") / total).otherwise(0.0),
        }
    )


def has_spread() -> Column:
    return (F.abs("d1") > 1e-10) | (F.abs("d2") > 1e-10)


def passes_margin(threshold: float = 0.025) -> Column:
    total = F.col("yea") + F.col("nay")
    return (total > 0) & (F.least("yea", "nay") / total >= threshold)


def mark_valid(bills: DataFrame, threshold: float = 0.025) -> DataFrame:
    """Usable roll call: enough minority votes and a non-zero spread."""
    return bills.withColumn(
        "valid", F.coalesce(passes_margin(threshold) & has_spread(), F.lit(False))
    )


def zero_invalid(bills: DataFrame) -> DataFrame:
    names = ("z1", "z2", "d1", "d2")
    return bills.withColumns(
        {c: F.when(F.col("valid"), F.col(c)).otherwise(0.0) for c in names}
    )


def placements(votes: DataFrame) -> DataFrame:
    """(member, period) pairs with at least one real vote."""
    return drop_missing(votes).select("legislator_id", "period").distinct()


def member_presence(cells: DataFrame) -> DataFrame:
    """Per member: does any cell hold a code other than -1 and 9."""
    return cells.groupBy("legislator_id").agg(
        F.bool_or(V.is_present_code(F.col("code"))).alias("present")
    )


def roster_members(cells: DataFrame) -> DataFrame:
    return member_presence(cells).where("present").select("legislator_id")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Keep the last row of every key; a partial aggregate, not a per-key sort."""
    rest = [c for c in rows.columns if c not in key and c != order]
    record = F.struct(*rest)
    return (
        rows.groupBy(*key)
        .agg(F.max_by(record, F.col(order)).alias("_last"))
        .select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def min_participation(votes: DataFrame, least: int = 25) -> DataFrame:
    return (
        drop_missing(votes)
        .groupBy("legislator_id")
        .agg(F.count("*").alias("votes"))
        .where(F.col("votes") >= least)
    )


def keep_members(votes: DataFrame, chamber: DataFrame) -> DataFrame:
    """Votes whose voter is on the chamber list."""
    return votes.join(chamber.select("legislator_id"), "legislator_id", "left_semi")


def period_range(votes: DataFrame, first: int | None, last: int | None) -> DataFrame:
    if first is not None:
        votes = votes.where(F.col("period") >= first)
    if last is not None:
        votes = votes.where(F.col("period") <= last)
    return votes


def drop_origin(coords: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    return coords.where(
        (F.abs("coord1D") > tolerance) | (F.abs("coord2D") > tolerance)
    )


def attempted_rows(trace: DataFrame) -> DataFrame:
    """Trace rows with their outcome: skipped, accepted or rejected."""
    return trace.withColumn(
        "outcome",
        F.when(F.col("attempted") == 0, "skipped")
        .when(F.col("accepted") == 1, "accepted")
        .otherwise("rejected"),
    )
