"""Votes laid out once per fit: hash blocks of whole groups, oversized groups apart.

Small groups (roll calls or members) are hashed into blocks of a bounded number of
rows; a block is one numpy task.  A group above `Limits.group_rows` never enters a
block: its rows stay spread over the cluster and are summed by Spark aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..session import broadcast_within, ship_package


@dataclass
class Layout:
    key: str
    blocks: int
    small: DataFrame
    hot: DataFrame | None
    hot_keys: DataFrame | None
    hot_count: int
    rows: int
    tasks: int
    laid: bool

    def block_of(self, df: DataFrame) -> DataFrame:
        return df.withColumn("block", block_column(self.key, self.blocks))

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows of `small` and its joins by block, in the tasks that the counts ask for: the bytes
        of the rows say little about the work of the solvers."""
        return df if self.laid else df.repartition(self.tasks, "block")

    def release(self) -> None:
        self.small.unpersist()
        if self.hot is not None:
            self.hot.unpersist()


def block_column(key: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")


def lay_out(
    rows: DataFrame, key: str, limits: Limits, reuse: bool = False, sizes: DataFrame | None = None
) -> Layout:
    """Count the groups and split off the oversized ones.

    `reuse` caches the block layout for a loop; a single pass needs no cache. `sizes` (key, n) are
    the rows of every group where they are known.
    """
    spark = rows.sparkSession
    ship_package(spark)
    if sizes is None:
        sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    hot_if = F.col("n") > limits.group_rows
    total, hot_count, all_rows = sizes.agg(
        F.sum(F.when(~hot_if, F.col("n"))), F.count_if(hot_if), F.sum("n")
    ).first()
    total = total or 0
    cores = spark.sparkContext.defaultParallelism
    blocks = max(
        1,
        -(-total // limits.block_rows),
        min(4 * cores, total // limits.least_block_rows),
    )
    hot = hot_keys = None
    small = rows
    if hot_count:
        # At most (all rows / group_rows) keys, so this table is small by construction.
        hot_keys = sizes.where(hot_if).select(key, F.col("n").alias("rows"))
        small = rows.join(_sized(hot_keys, hot_count, limits), key, "left_anti")
        hot = rows.join(_sized(hot_keys, hot_count, limits), key)
        # Slices of a group lie together and sorted, so a task meets few groups, whole batches of
        # one at a time.
        others = [c for c in rows.columns if c != key]
        slices = F.ceil(F.col("rows") / limits.slice_rows).cast("long")
        hot = hot.withColumn("slice", F.pmod(F.xxhash64(*others), slices)).drop("rows")
        hot = hot.repartition(key, "slice").sortWithinPartitions(key).drop("slice")
        hot = hot.persist(StorageLevel.MEMORY_AND_DISK)
    tasks = max(1, min(blocks, 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    small = small.withColumn("block", block_column(key, blocks))
    if reuse:
        small = small.repartition(tasks, "block").persist(StorageLevel.MEMORY_AND_DISK)
    return Layout(key, blocks, small, hot, hot_keys, hot_count, all_rows or 0, tasks, reuse)


def _sized(keys: DataFrame, count: int, limits: Limits) -> DataFrame:
    return broadcast_within(keys, count, limits.broadcast_rows)


@dataclass
class HotGroups:
    """Oversized groups that a solver advances together: keys in order, their counts and rows."""

    keys: list
    counts: list
    rows: DataFrame


def hot_groups(layout: Layout, limits: Limits, wanted: DataFrame | None = None):
    """The oversized groups (of `wanted` only, if given), as a rule all at once; the batches only
    bound what the driver holds for the solver."""
    if not layout.hot_count:
        return
    key, keys = layout.key, layout.hot_keys
    if wanted is not None:
        keys = keys.join(wanted.select(key), key, "left_semi")
    parts = -(-layout.hot_count // limits.hot_batch)
    for part in range(parts):
        mine = keys.where(block_column(key, parts) == part)
        found = mine.orderBy(key).collect()
        if found:
            rows = layout.hot.join(_sized(mine.select(key), len(found), limits), key, "left_semi")
            yield HotGroups([r[key] for r in found], [r["rows"] for r in found], rows)
