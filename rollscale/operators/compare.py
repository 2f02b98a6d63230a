"""Fit against fit: joins, alignment, correlations, gauges, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..functions.votes import PARTY_SCORES
from .running import LIMITS, average_ranks, medians
from .totals import with_totals

KEYS = ["legislator_id", "period"]


def served_only(coords: DataFrame, placements: DataFrame) -> DataFrame:
    """Drop padded rows of members who did not serve in the period."""
    return coords.join(placements.select(*KEYS), KEYS, "left_semi")


def join_fits(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Matched positions a1, a2, b1, b2 on the keys."""
    keys = keys or KEYS
    left = a.select(*keys, F.col("coord1D").alias("a1"), F.col("coord2D").alias("a2"))
    right = b.select(*keys, F.col("coord1D").alias("b1"), F.col("coord2D").alias("b2"))
    return left.join(right, keys)


def join_three(a: DataFrame, external: DataFrame, c: DataFrame) -> DataFrame:
    """Fit, published scores and a second fit on common keys."""
    scores = drop_null_scores(external).select(
        "legislator_id", F.col("dim1").alias("e1"), F.col("dim2").alias("e2")
    )
    return join_fits(a, c).join(scores, "legislator_id")


def drop_null_scores(external: DataFrame) -> DataFrame:
    return external.where(F.col("dim1").isNotNull())


def with_party(coords: DataFrame, roster: DataFrame, default: str = "IND") -> DataFrame:
    return coords.join(
        roster.select("legislator_id", "party"), "legislator_id", "left"
    ).withColumn("party", F.coalesce(F.col("party").cast("string"), F.lit(default)))


def with_party_score(rows: DataFrame) -> DataFrame:
    """Left-right score of a party label; unknown labels score 0."""
    spark = rows.sparkSession
    lookup = spark.createDataFrame(
        list(PARTY_SCORES.items()), "party string, party_score double"
    )
    return rows.join(F.broadcast(lookup), "party", "left").fillna({"party_score": 0.0})


def party_era(rows: DataFrame, period: str = "period") -> DataFrame:
    """First and second party code of the era a period falls in (0 outside)."""
    from ..functions.votes import PARTY_ERAS

    spark = rows.sparkSession
    # One row per period of an era: an equality lookup of fixed size.
    lookup = spark.createDataFrame(
        [(p, one, two) for low, high, one, two in PARTY_ERAS for p in range(low, high + 1)],
        f"{period} int, party1 int, party2 int",
    )
    return rows.join(F.broadcast(lookup), period, "left").fillna({"party1": 0, "party2": 0})


def key_difference(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys that only one of two states holds, with the side."""
    keys = keys or KEYS
    left = a.select(*keys).exceptAll(b.select(*keys)).withColumn("side", F.lit("left"))
    right = b.select(*keys).exceptAll(a.select(*keys)).withColumn("side", F.lit("right"))
    return left.unionByName(right)


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Unmatched and duplicate keys of two states; all zero means one to one."""
    left = a.groupBy(*keys).agg(F.count("*").alias("n_left"))
    right = b.groupBy(*keys).agg(F.count("*").alias("n_right"))
    both = left.join(right, keys, "full")
    return both.agg(
        F.count_if(F.col("n_left").isNotNull() & F.col("n_right").isNotNull()).alias("matched"),
        F.count_if(F.col("n_right").isNull()).alias("only_left"),
        F.count_if(F.col("n_left").isNull()).alias("only_right"),
        F.count_if((F.col("n_left") > 1) | (F.col("n_right") > 1)).alias("duplicates"),
    )


def max_component_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    left = a.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"a_{c}") for c in columns])
    right = b.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"b_{c}") for c in columns])
    gaps = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns]
    distance = F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))
    return left.join(right, keys).agg(
        F.max(F.array_max(F.array(*gaps))).alias("max_difference"), F.max(distance).alias("max_distance")
    )


def alignment(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Orthogonal map of fit a onto fit b, centred, without scaling, per group.

    The 2x2 problem has a closed form: of the best rotation and the best
    reflection keep the one with the larger trace.  One pass of sums.
    """
    by = by or []
    n = F.count("*")
    sums = {"n": n}
    for c in ("a1", "a2", "b1", "b2"):
        sums[f"m_{c}"] = F.avg(c)
    for i in "12":
        for j in "12":
            # Centred while it is summed: no digits cancel on a large panel.
            sums[f"x{i}{j}"] = F.covar_pop(f"a{i}", f"b{j}") * n
    df = matched.groupBy(*by).agg(*[e.alias(k) for k, e in sums.items()])
    p, q = F.col("x11") + F.col("x22"), F.col("x12") - F.col("x21")
    r, s = F.col("x11") - F.col("x22"), F.col("x12") + F.col("x21")
    df = df.withColumns({"turn": F.sqrt(p * p + q * q), "mirror": F.sqrt(r * r + s * s)})
    rotate = F.col("turn") >= F.col("mirror")
    size = F.greatest("turn", "mirror")
    size = F.when(size > 0, size).otherwise(1.0)
    return df.select(
        *by,
        "n",
        *[f"m_{c}" for c in ("a1", "a2", "b1", "b2")],
        (F.when(rotate, p).otherwise(r) / size).alias("r11"),
        (F.when(rotate, q).otherwise(s) / size).alias("r12"),
        (F.when(rotate, -q).otherwise(s) / size).alias("r21"),
        (F.when(rotate, p).otherwise(-r) / size).alias("r22"),
        rotate.cast("int").alias("rotation"),
    )


def align(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Matched rows with aligned positions and raw/aligned distances."""
    by = by or []
    maps = alignment(matched, by)
    joined = matched.join(maps, by) if by else with_totals(matched, maps)
    u1, u2 = F.col("a1") - F.col("m_a1"), F.col("a2") - F.col("m_a2")
    aligned = joined.withColumns(
        {
            "aligned1": u1 * F.col("r11") + u2 * F.col("r21") + F.col("m_b1"),
            "aligned2": u1 * F.col("r12") + u2 * F.col("r22") + F.col("m_b2"),
        }
    )
    return aligned.select(
        *matched.columns,
        "aligned1",
        "aligned2",
        _distance("aligned1", "aligned2").alias("displacement"),
        _distance("a1", "a2").alias("raw_displacement"),
    )


def _distance(c1: str, c2: str) -> Column:
    g1, g2 = F.col(c1) - F.col("b1"), F.col(c2) - F.col("b2")
    return F.sqrt(g1 * g1 + g2 * g2)


def scores(aligned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Correlations, scale ratios and distances of aligned rows."""
    by = by or []
    return aligned.groupBy(*by).agg(
        F.count("*").alias("matched"),
        F.corr("aligned1", "b1").alias("r1"),
        F.corr("aligned2", "b2").alias("r2"),
        (F.stddev_pop("aligned1") / F.stddev_pop("b1")).alias("scale1"),
        (F.stddev_pop("aligned2") / F.stddev_pop("b2")).alias("scale2"),
        F.avg("displacement").alias("mean_distance"),
        F.max("displacement").alias("max_distance"),
        F.max("raw_displacement").alias("raw_max_distance"),
    )


def displacement_stats(aligned: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Scores plus the exact median displacement."""
    middle = medians(
        aligned.select("displacement"), [], "displacement", "median_distance", limits
    ).drop("n")
    return with_totals(scores(aligned), middle)


def spearman(
    rows: DataFrame, a: str, b: str, by: list[str] | None = None, limits: Limits = LIMITS
) -> DataFrame:
    """Pearson correlation of average ranks."""
    by = by or []
    ranked = average_ranks(rows.select(*by, a, b), by, a, "rank_a", limits)
    ranked = average_ranks(ranked, by, b, "rank_b", limits)
    return ranked.groupBy(*by).agg(F.corr("rank_a", "rank_b").alias("rho"))


def orient_dim1(rows: DataFrame, right: list[str]) -> DataFrame:
    """Flip dimension 1 if the named parties have a negative mean."""
    mean = rows.where(F.col("party").isin(*right)).agg(F.avg("coord1D").alias("_mean"))
    sign = F.when(F.col("_mean") < 0, -1.0).otherwise(1.0)
    return (
        with_totals(rows, mean)
        .withColumn("coord1D", F.col("coord1D") * sign)
        .drop("_mean")
    )


def dim2_gauge(a: DataFrame, reference: DataFrame) -> DataFrame:
    """Correlation of dimension 2 with a reference and whether it pins the sign."""
    return (
        join_fits(a, reference)
        .agg(F.corr("a2", "b2").alias("r"), F.count("*").alias("matched"))
        .withColumn(
            "verdict",
            F.when(F.abs("r") >= 0.3, "well determined").otherwise("ambiguous"),
        )
    )


def _turn_dim2(rows: DataFrame, a: DataFrame, reference: DataFrame) -> DataFrame:
    gauge = dim2_gauge(a, reference).select(
        F.when((F.col("matched") >= 3) & (F.col("r") < 0), -1.0).otherwise(1.0).alias("_sign")
    )
    return (
        with_totals(rows, gauge)
        .withColumn("coord2D", F.col("coord2D") * F.col("_sign"))
        .drop("_sign")
    )


def orient_dim2(a: DataFrame, reference: DataFrame) -> DataFrame:
    """Flip dimension 2 when at least three matches correlate negatively."""
    return _turn_dim2(a, a, reference)


def party_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("party").agg(
        F.count("*").alias("members"),
        F.avg("coord1D").alias("mean1"),
        F.avg("coord2D").alias("mean2"),
    )


def career_mean(coords: DataFrame) -> DataFrame:
    return coords.groupBy("legislator_id").agg(
        F.avg("coord1D").alias("coord1D"), F.avg("coord2D").alias("coord2D")
    )


def vote_bin(count: Column) -> Column:
    """Participation bins."""
    return (
        F.when(count.between(0, 24), "1-24")
        .when(count.between(25, 49), "25-49")
        .when(count.between(50, 99), "50-99")
        .when(count.between(100, 199), "100-199")
        .when(count >= 200, "200+")
    )


def displacement_by_bin(
    aligned: DataFrame, counts: DataFrame, limits: Limits = LIMITS
) -> DataFrame:
    """Displacement statistics per participation bin of the member."""
    binned = aligned.join(counts, "legislator_id").withColumn(
        "vote_bin", vote_bin(F.col("votes"))
    )
    stats = binned.groupBy("vote_bin").agg(
        F.count("*").alias("members"),
        F.avg("votes").alias("mean_votes"),
        F.avg("displacement").alias("mean_displacement"),
        F.max("displacement").alias("max_displacement"),
    )
    middle = medians(
        binned.select("vote_bin", "displacement"),
        ["vote_bin"],
        "displacement",
        "median_displacement",
        limits,
    ).drop("n")
    return stats.join(middle, "vote_bin")


def input_profile(votes: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Active members, roll calls, median participation and the share below 25 votes."""
    counts = (
        votes.groupBy("legislator_id")
        .agg(F.count_if(F.col("vote").isNotNull()).alias("votes"))
        .where(F.col("votes") > 0)
    )
    members = counts.agg(
        F.count("*").alias("active_members"),
        F.count_if(F.col("votes") < 25).alias("members_below_25_votes"),
    ).withColumn(
        "share_below_25_votes",
        F.col("members_below_25_votes") / F.greatest(F.col("active_members"), F.lit(1)),
    )
    items = votes.select("rollcall_id").distinct().agg(F.count("*").alias("roll_calls"))
    middle = medians(counts, [], "votes", "median_votes", limits).drop("n")
    return with_totals(with_totals(members, items), middle)


def input_shape(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Vote records, chamber members, roll calls and matrix size per period."""
    shape = votes.groupBy("period").agg(
        F.count("*").alias("vote_records"),
        F.count_distinct("legislator_id").alias("members"),
        F.count_distinct("rollcall_id").alias("roll_calls"),
    )
    roster = members.agg(F.count("*").alias("roster"))
    return with_totals(shape, roster).withColumn(
        "matrix_cells", F.col("roster") * F.col("roll_calls")
    )


def always_present(placements: DataFrame, periods: int | None = None) -> DataFrame:
    """Members placed in every period of the panel."""
    per_member = placements.groupBy("legislator_id").agg(
        F.count_distinct("period").alias("served")
    )
    if periods is not None:
        return per_member.where(F.col("served") == periods).select("legislator_id")
    total = placements.agg(F.count_distinct("period").alias("_periods"))
    return (
        with_totals(per_member, total)
        .where(F.col("served") == F.col("_periods"))
        .select("legislator_id")
    )


def period_swing(coords: DataFrame, members: DataFrame) -> DataFrame:
    """Range of dimension 1 across periods of the given members."""
    return (
        coords.join(members, "legislator_id", "left_semi")
        .groupBy("legislator_id")
        .agg((F.max("coord1D") - F.min("coord1D")).alias("swing"))
    )


def anchors(coords: DataFrame, members: DataFrame, each: int = 3) -> DataFrame:
    """Members with the lowest and the highest mean score (a top-k report)."""
    means = (
        coords.join(members, "legislator_id", "left_semi")
        .groupBy("legislator_id")
        .agg(F.avg("coord1D").alias("mean1"))
    )
    low = means.orderBy("mean1", "legislator_id").limit(each)
    high = means.orderBy(F.desc("mean1"), F.desc("legislator_id")).limit(each)
    return low.withColumn("side", F.lit("low")).unionByName(
        high.withColumn("side", F.lit("high"))
    )


def ball_report(points: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Points, largest radius and count outside the unit ball of a map slice."""
    r = F.hypot("coord1D", "coord2D")
    return points.agg(
        F.count("*").alias("points"),
        F.max(r).alias("max_radius"),
        F.count_if(r > 1.0 + tolerance).alias("outside"),
    )


def map_slice(
    coords: DataFrame,
    roster: DataFrame,
    reference: DataFrame,
    right: list[str],
    period: int | None = None,
    centres: DataFrame | None = None,
) -> DataFrame:
    """Rows of one map, oriented, with party and score.

    The positions are one period, the career mean, or given centres such as path
    intercepts; the sign of dimension 2 always comes from the period positions.
    """
    if centres is not None:
        rows = _turn_dim2(centres, coords, reference)
    elif period is None:
        rows = career_mean(orient_dim2(coords, reference))
    else:
        turned = orient_dim2(coords, reference)
        rows = turned.where(F.col("period") == period).drop("period")
    labelled = with_party_score(with_party(rows, roster))
    return orient_dim1(labelled, right)


def equivalence(
    ll_a: DataFrame, ll_b: DataFrame, differences: DataFrame, tolerance: float = 1e-6
) -> DataFrame:
    """Likelihood and parameter verdict of two one-row evaluations."""
    gap = F.col("ll_a") - F.col("ll_b")
    both = with_totals(
        ll_a.select(F.col("log_likelihood").alias("ll_a")),
        ll_b.select(F.col("log_likelihood").alias("ll_b")),
    )
    return (
        with_totals(both, differences.select("max_difference"))
        .select(
            "ll_a",
            "ll_b",
            gap.alias("ll_difference"),
            (F.abs(gap) <= tolerance).cast("int").alias("objective_equivalent"),
            (F.col("max_difference") <= tolerance).cast("int").alias("parameter_equivalent"),
            ((F.abs(gap) <= tolerance) & (F.col("max_difference") <= tolerance))
            .cast("int")
            .alias("equivalent"),
            (gap > tolerance).cast("int").alias("a_is_better"),
        )
    )


def gates(metrics: DataFrame, expectations: DataFrame) -> DataFrame:
    """Metrics (name, value) against floors and ceilings; one verdict per gate."""
    joined = expectations.join(metrics, "metric", "left")
    ok = F.col("value").isNotNull() & (
        F.coalesce(F.col("value") >= F.col("low"), F.col("low").isNull())
        & F.coalesce(F.col("value") <= F.col("high"), F.col("high").isNull())
    )
    return joined.withColumn("passed", F.coalesce(ok, F.lit(False)).cast("int"))


def drift(coords: DataFrame, members: DataFrame) -> DataFrame:
    """First and last position on dimension 1 and the distance between them."""
    ends = (
        coords.join(members, "legislator_id", "left_semi")
        .groupBy("legislator_id")
        .agg(
            F.min_by("coord1D", "period").alias("first"),
            F.max_by("coord1D", "period").alias("last"),
        )
    )
    return ends.withColumn("drift", F.col("last") - F.col("first"))
