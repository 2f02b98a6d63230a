"""Cut points of all roll calls in one job, and what follows from a cut.

Points are rows (rollcall_id, legislator_id, proj, vote); a null vote is an absent
member, who shapes the candidate positions but no count.  Equal projections keep
the member order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..functions.ball import project_to_ball
from .running import LIMITS, Running, largest_group, running

TIE = 1e-5
EDGE = 0.001


def floor_cloud(cells: DataFrame, placements: DataFrame) -> DataFrame:
    """Cells of members served in the period; absent members stay with code 9."""
    return (
        cells.join(placements.select("legislator_id", "period"), ["legislator_id", "period"])
        .withColumn("code", F.when(F.col("vote").isNull(), 9).otherwise(F.col("code")))
    )


def sort_points(points: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Stable 1-based position of every point on its roll call's axis."""
    return running(
        points,
        ["rollcall_id"],
        ["proj", "legislator_id"],
        {"position": Running(F.lit(1).cast("long"), span="upto")},
        limits,
    )


def _yes() -> Column:
    return F.coalesce(F.col("vote").cast("long"), F.lit(0).cast("long"))


def _no() -> Column:
    return F.coalesce((~F.col("vote")).cast("long"), F.lit(0).cast("long"))


def cut_candidates(
    points: DataFrame, limits: Limits = LIMITS, largest: int | None = None
) -> DataFrame:
    """One candidate per point: its cut and the real votes on its left and overall."""
    counted = running(
        points,
        ["rollcall_id"],
        ["proj", "legislator_id"],
        {
            "idx": Running(F.lit(1).cast("long")),
            "prev": Running(F.col("proj"), kind="max"),
            "yes_left": Running(_yes()),
            "no_left": Running(_no()),
            "yes_all": Running(_yes(), span="total"),
            "no_all": Running(_no(), span="total"),
        },
        limits,
        largest,
    )
    return counted.withColumn(
        "cut",
        F.coalesce((F.col("proj") + F.col("prev")) / 2.0, F.col("proj") - EDGE),
    ).drop("prev")


def polarity_counts(candidates: DataFrame) -> DataFrame:
    """Correct/error counts on both sides of every cut, for both polarities."""
    yl, nl = F.col("yes_left"), F.col("no_left")
    yr, nr = F.col("yes_all") - yl, F.col("no_all") - nl

    def side(polarity, correct_low, error_low, correct_high, error_high):
        return F.struct(
            F.lit(polarity).alias("polarity"),
            correct_low.alias("correct_low"),
            error_low.alias("error_low"),
            correct_high.alias("correct_high"),
            error_high.alias("error_high"),
        )

    both = F.array(side("yes_low", yl, nl, nr, yr), side("no_low", nl, yl, yr, nr))
    total = F.col("yes_all") + F.col("no_all")
    errors = F.col("error_low") + F.col("error_high")
    return (
        candidates.select("rollcall_id", "idx", "cut", "yes_all", "no_all", F.inline(both))
        .withColumn("error_rate", F.when(total > 0, errors / total).otherwise(999.0))
    )


def best_cuts(
    points: DataFrame, limits: Limits = LIMITS, fixed: Column | None = None
) -> DataFrame:
    """Least-error cut per roll call.

    Ties within 1e-5 of the best rate go to the cut nearest the origin, then to
    the first one; between polarities the yes-low side wins ties.  `fixed` is a
    column of the points that names the only polarity to test.
    """
    largest = largest_group(points, ["rollcall_id"])
    candidates = cut_candidates(points, limits, largest)
    total = F.col("yes_all") + F.col("no_all")
    err = {
        "yes_low": F.col("no_left") + F.col("yes_all") - F.col("yes_left"),
        "no_low": F.col("yes_left") + F.col("no_all") - F.col("no_left"),
    }

    def record(name: str, with_error: bool) -> Column:
        lead = [err[name].alias("errors")] if with_error else []
        return F.struct(
            *lead,
            F.abs("cut").alias("distance"),
            F.col("idx").alias("idx"),
            F.col("cut").alias("cut"),
            err[name].alias("n_errors"),
            F.col("yes_left").alias("yes_left"),
            F.col("no_left").alias("no_left"),
        )

    keep = [F.first("yes_all").alias("yes_all"), F.first("no_all").alias("no_all")]
    if fixed is not None:
        keep.append(F.first(fixed).alias("fixed"))
    grouped = candidates.groupBy("rollcall_id")
    if largest * TIE < 1.0:
        # One error more always exceeds the tolerance, so the order is exact.
        picked = grouped.agg(
            *[F.min(record(n, True)).alias(n) for n in err], *keep
        )
    else:
        least = grouped.agg(*[F.min(e).alias(f"least_{n}") for n, e in err.items()])
        tied = candidates.join(least, "rollcall_id")
        picked = tied.groupBy("rollcall_id").agg(
            *[
                F.min(
                    F.when(
                        e - F.col(f"least_{n}") <= TIE * F.greatest(total, F.lit(1)),
                        record(n, False),
                    )
                ).alias(n)
                for n, e in err.items()
            ],
            *keep,
        )
    yes_first = F.col("yes_low.n_errors") <= F.col("no_low.n_errors")
    if fixed is not None:
        yes_first = F.col("fixed") == "yes_low"
    best = picked.select(
        "rollcall_id",
        "yes_all",
        "no_all",
        F.when(yes_first, "yes_low").otherwise("no_low").alias("polarity"),
        F.when(yes_first, F.col("yes_low.cut")).otherwise(F.col("no_low.cut")).alias("cut"),
        F.when(yes_first, F.col("yes_low.n_errors"))
        .otherwise(F.col("no_low.n_errors"))
        .alias("errors"),
        F.when(yes_first, F.col("yes_low.yes_left"))
        .otherwise(F.col("no_low.yes_left"))
        .alias("yes_left"),
        F.when(yes_first, F.col("yes_low.no_left"))
        .otherwise(F.col("no_low.no_left"))
        .alias("no_left"),
    )
    yes_low = F.col("polarity") == "yes_low"
    yl, nl = F.col("yes_left"), F.col("no_left")
    yr, nr = F.col("yes_all") - yl, F.col("no_all") - nl
    return best.select(
        "rollcall_id",
        "polarity",
        "cut",
        F.when(yes_low, yl).otherwise(nl).alias("correct_low"),
        F.when(yes_low, nl).otherwise(yl).alias("error_low"),
        F.when(yes_low, nr).otherwise(yr).alias("correct_high"),
        F.when(yes_low, yr).otherwise(nr).alias("error_high"),
        "errors",
        (F.col("yes_all") + F.col("no_all")).alias("classified"),
        F.when(total > 0, F.col("errors") / total).otherwise(999.0).alias("error_rate"),
    )


def classify(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """Side, correctness and error code (-1 absent, 0 right, 1 wrong) per member."""
    joined = points.join(cuts.select("rollcall_id", "cut", "polarity"), "rollcall_id")
    low, high = F.col("proj") < F.col("cut"), F.col("proj") > F.col("cut")
    low_vote = F.col("vote") == (F.col("polarity") == "yes_low")
    return joined.withColumns(
        {
            "side": F.when(low, "low").when(high, "high"),
            "error": F.when(F.col("vote").isNull() | ~(low | high), -1)
            .when((low & low_vote) | (high & ~low_vote), 0)
            .otherwise(1),
        }
    )


def centroids(classified: DataFrame) -> DataFrame:
    """Mean position of the correct and wrong voters on each side of the cut."""
    return (
        classified.where(F.col("error") >= 0)
        .groupBy("rollcall_id", "side", "error")
        .agg(F.count("*").alias("members"), F.avg("x1").alias("c1"), F.avg("x2").alias("c2"))
    )


def projection_means(points: DataFrame) -> DataFrame:
    """Mean projection and count of the yes and of the no voters."""
    return points.groupBy("rollcall_id").agg(
        F.coalesce(F.avg(F.when(F.col("vote"), F.col("proj"))), F.lit(0.0)).alias("mean_yes"),
        F.coalesce(F.avg(F.when(~F.col("vote"), F.col("proj"))), F.lit(0.0)).alias("mean_no"),
        F.count_if("vote").alias("n_yes"),
        F.count_if(~F.col("vote")).alias("n_no"),
    )


def errors_by_member(classified: DataFrame) -> DataFrame:
    return classified.groupBy("legislator_id").agg(
        F.count_if(F.col("error") == 1).alias("errors"),
        F.count_if(F.col("error") >= 0).alias("classified"),
    )


def accuracy(cuts: DataFrame) -> DataFrame:
    """Overall classification of all cuts; accuracy 1 when nothing was classified."""
    return cuts.agg(
        F.coalesce(F.sum("classified"), F.lit(0)).alias("classified"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
    ).withColumns(
        {
            "error_rate": F.when(
                F.col("classified") > 0, F.col("errors") / F.col("classified")
            ).otherwise(0.0),
            "accuracy": F.when(
                F.col("classified") > 0, 1.0 - F.col("errors") / F.col("classified")
            ).otherwise(1.0),
        }
    )


def starts_from_cuts(cuts: DataFrame) -> DataFrame:
    """Midpoint and spread implied by a cut and its normal (n1, n2).

    The normal is turned so that its first component is not negative; the midpoint
    lies on the plane inside the ball and the spread points to the yes side.
    """
    turned = F.when(F.col("n1") < 0, -1.0).otherwise(1.0)
    flipped = F.when(
        F.col("n1") < 0,
        F.when(F.col("polarity") == "yes_low", "no_low").otherwise("yes_low"),
    ).otherwise(F.col("polarity"))
    df = cuts.select(
        "rollcall_id",
        (F.col("n1") * turned).alias("n1"),
        (F.col("n2") * turned).alias("n2"),
        (F.col("cut") * turned).alias("cut"),
        flipped.alias("polarity"),
    )
    z1, z2 = project_to_ball(F.col("cut") * F.col("n1"), F.col("cut") * F.col("n2"))
    sign = F.when(F.col("polarity") == "yes_low", 0.5).otherwise(-0.5)
    return df.select(
        "rollcall_id",
        z1.alias("z1"),
        z2.alias("z2"),
        (F.col("n1") * sign).alias("d1"),
        (F.col("n2") * sign).alias("d2"),
        "polarity",
    )


def best_turn(turns: DataFrame) -> DataFrame:
    """Turn with the fewest errors per roll call; the last of the ties."""
    record = F.struct((-F.col("errors")).alias("rank"), "turn")
    return turns.groupBy("rollcall_id").agg(F.max(record).alias("b")).select(
        "rollcall_id", "b.turn", (-F.col("b.rank")).alias("errors")
    )


def best_step(steps: DataFrame, key: str, first: bool) -> DataFrame:
    """Line-search point of the highest GMP; `first` or last of the ties."""
    order = -F.col("step") if first else F.col("step")
    record = F.struct("gmp", order.alias("order"), "step")
    return steps.groupBy(key).agg(F.max(record).alias("b")).select(key, "b.step", "b.gmp")
