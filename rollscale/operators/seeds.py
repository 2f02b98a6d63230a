"""Start positions: per placement, then per member, then the origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.votes import round_start
from .running import LIMITS, Running, running


def assign(
    placements: DataFrame,
    member_seeds: DataFrame | None,
    period_seeds: DataFrame | None,
    rounded: bool = False,
) -> DataFrame:
    """Coordinates and their provenance for every placement."""
    df = placements.select("legislator_id", "period")
    empty = F.lit(None).cast("double")
    levels = []
    for name, seeds, keys in (
        ("period", period_seeds, ["legislator_id", "period"]),
        ("member", member_seeds, ["legislator_id"]),
    ):
        if seeds is None:
            df = df.withColumns({f"{name}1": empty, f"{name}2": empty})
        else:
            complete = seeds.where(F.col("x1").isNotNull() & F.col("x2").isNotNull())
            df = df.join(
                complete.select(
                    *keys, F.col("x1").alias(f"{name}1"), F.col("x2").alias(f"{name}2")
                ),
                keys,
                "left",
            )
        levels.append(name)
    x1 = F.coalesce("period1", "member1", F.lit(0.0))
    x2 = F.coalesce("period2", "member2", F.lit(0.0))
    if rounded:
        x1, x2 = round_start(x1), round_start(x2)
    return df.select(
        "legislator_id",
        "period",
        x1.alias("x1"),
        x2.alias("x2"),
        F.when(F.col("period1").isNotNull(), "period")
        .when(F.col("member1").isNotNull(), "member")
        .otherwise("fallback")
        .alias("provenance"),
    )


def coverage(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("provenance").agg(F.count("*").alias("placements"))


def ramp(members: DataFrame, limits=LIMITS) -> DataFrame:
    """Legacy fallback: x = rank/N - 0.5 and a tenth of the rank share, sign alternating."""
    placed = running(
        members.select("legislator_id"),
        [],
        ["legislator_id"],
        {
            "rank": Running(F.lit(1).cast("long")),
            "n": Running(F.lit(1).cast("long"), span="total"),
        },
        limits,
    )
    share = F.col("rank") / F.col("n")
    side = F.when(F.col("rank") % 2 == 0, 0.1).otherwise(-0.1)
    return placed.select(
        "legislator_id", (share - 0.5).alias("x1"), (share * side).alias("x2")
    )


def bill_ids(starts: DataFrame, periods: DataFrame) -> DataFrame:
    """(session, ID) starts to global roll-call ids; local ids out of range drop out.

    periods: period, n_rollcalls, rc_offset.
    """
    joined = starts.join(periods, starts["session"] == periods["period"])
    return joined.where(
        (F.col("ID") >= 1) & (F.col("ID") <= F.col("n_rollcalls"))
    ).withColumn("rollcall_id", F.col("rc_offset") + F.col("ID") - 1)


def period_offsets(margins: DataFrame) -> DataFrame:
    """Roll calls per period and the running offset of the first one."""
    counts = margins.groupBy("period").agg(F.count("*").alias("n_rollcalls"))
    # One row per period.
    return running(
        counts, [], ["period"], {"rc_offset": Running(F.col("n_rollcalls"))}
    )


def rejoin_state(placements: DataFrame, coords: DataFrame) -> DataFrame:
    """Saved coordinates as per-period seeds of the placements."""
    stored = coords.select(
        "legislator_id",
        "period",
        F.col("coord1D").alias("x1"),
        F.col("coord2D").alias("x2"),
    )
    return assign(placements, None, stored)
