"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscale.llm.common import joined, stored


def _state(edges: DataFrame):
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()


def components(edges: DataFrame) -> DataFrame:
    """key and label (the smallest key of its component) of every key in the edges (a, b).

    Large-star: a vertex hands its larger neighbours to its smallest one; small-star: its smaller
    neighbours. Both shrink paths until only stars are left, in about log(longest path) rounds.
    Each round is written, so lineage stays short; nothing but two sums reaches the driver.
    Null keys and edges from a key to itself are ignored.
    """
    stars = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _state(stars)
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            joined(both, least, "a")
            .where("b > a AND b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.union(
            least.where("m <> a").select("a", F.col("m").alias("b"))
        ).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = joined(large, lower, "a")
        stars = stored(
            small.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lower.select("a", F.col("m").alias("b")))
            .distinct(),
            "stars",
        )
        after = _state(stars)
        if after == before:
            break
        before = after
    leaves = stars.select(F.col("a").alias("key"), F.col("b").alias("label"))
    return leaves.union(
        stars.select(F.col("b").alias("key"), F.col("b").alias("label")).distinct()
    )
