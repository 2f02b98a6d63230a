"""Ordered running aggregates, ranks and order statistics that survive hot groups.

A plain window puts a whole group into one task.  `running` counts the groups
first: while the largest one is small it uses the window; otherwise the rows
are range-partitioned by (group, order), so that a hot group is spread over many
blocks, and block totals are carried over.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Limits
from ..session import cut_lineage

LIMITS = Limits()


@dataclass(frozen=True)
class Running:
    """One running column: kind is sum or max; span is before, upto or total."""

    value: Column
    kind: str = "sum"
    span: str = "before"

    def aggregate(self, value: Column | None = None) -> Column:
        value = self.value if value is None else value
        return F.max(value) if self.kind == "max" else F.sum(value)

    def combine(self, local: Column, carried: Column) -> Column:
        if self.kind == "max":
            return F.greatest(local, carried)
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))


def largest_group(df: DataFrame, group: list[str]) -> int:
    counted = df.groupBy(*group).agg(F.count("*").alias("n"))
    return counted.agg(F.max("n")).first()[0] or 0


def _frame(window, span: str):
    if span == "before":
        return window.rowsBetween(Window.unboundedPreceding, -1)
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _windowed(df, group, order, columns):
    keys = Window.partitionBy(*group)
    out = {}
    for name, c in columns.items():
        over = keys if c.span == "total" else _frame(keys.orderBy(*order), c.span)
        value = c.aggregate().over(over)
        out[name] = F.coalesce(value, F.lit(0)) if c.kind == "sum" else value
    return df.withColumns(out)


def _blocked(df, group, order, columns, rows, block_rows):
    spark = df.sparkSession
    blocks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(1, block_rows))
    )
    placed = cut_lineage(
        df.repartitionByRange(blocks, *group, *order).withColumn(
            "_block", F.spark_partition_id()
        )
    )
    keys = [*group, "_block"]
    totals = placed.groupBy(*keys).agg(
        *[c.aggregate().alias(f"_{n}") for n, c in columns.items()]
    )
    # At most one row per block and group reaches these windows.
    by_group = Window.partitionBy(*group)
    carried = {}
    for n, c in columns.items():
        over = by_group if c.span == "total" else _frame(by_group.orderBy("_block"), "before")
        carried[f"_{n}"] = c.aggregate(F.col(f"_{n}")).over(over)
    offsets = totals.select(*keys, *[e.alias(n) for n, e in carried.items()])
    inside = Window.partitionBy(*keys).orderBy(*order)
    local = {
        n: c.aggregate().over(_frame(inside, c.span))
        for n, c in columns.items()
        if c.span != "total"
    }
    joined = placed.withColumns(local).join(offsets, keys)
    out = {
        n: F.col(f"_{n}") if c.span == "total" else c.combine(F.col(n), F.col(f"_{n}"))
        for n, c in columns.items()
    }
    return joined.withColumns(out).drop("_block", *[f"_{n}" for n in columns])


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    columns: dict[str, Running],
    limits: Limits = LIMITS,
    largest: int | None = None,
) -> DataFrame:
    """Add running columns; (group, order) must identify a row."""
    if largest is None:
        largest = largest_group(df, group)
    if largest <= limits.group_rows:
        return _windowed(df, group, order, columns)
    return _blocked(df, group, order, columns, df.count(), limits.group_rows)


def row_numbers(
    df: DataFrame, group: list[str], order: list[str], name: str, limits: Limits = LIMITS
) -> DataFrame:
    return running(df, group, order, {name: Running(F.lit(1).cast("long"), span="upto")}, limits)


def average_ranks(
    df: DataFrame, group: list[str], value: str, name: str, limits: Limits = LIMITS
) -> DataFrame:
    """Rank with ties sharing the mean; runs over distinct values only."""
    distinct = df.groupBy(*group, value).agg(F.count("*").alias("_ties"))
    ranked = running(
        distinct, group, [value], {"_before": Running(F.col("_ties"))}, limits
    ).select(
        *group, value, (F.col("_before") + (F.col("_ties") + 1) / 2.0).alias(name)
    )
    return df.join(ranked, [*group, value])


def order_statistics(
    df: DataFrame,
    group: list[str],
    value: str,
    wanted: Callable[[Column], dict[str, Column]],
    limits: Limits = LIMITS,
) -> DataFrame:
    """Exact values at 0-based sorted positions given as functions of the count."""
    distinct = df.groupBy(*group, value).agg(F.count("*").alias("_ties"))
    placed = running(
        distinct,
        group,
        [value],
        {
            "_before": Running(F.col("_ties")),
            "_n": Running(F.col("_ties"), span="total"),
        },
        limits,
    )
    aggs = []
    for name, index in wanted(F.col("_n")).items():
        here = (index >= F.col("_before")) & (index < F.col("_before") + F.col("_ties"))
        aggs.append(F.max(F.when(here, F.col(value))).alias(name))
    return placed.groupBy(*group).agg(*aggs, F.sum("_ties").alias("n"))


def medians(
    df: DataFrame, group: list[str], value: str, name: str, limits: Limits = LIMITS
) -> DataFrame:
    def middle(n: Column) -> dict[str, Column]:
        return {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}

    return order_statistics(df, group, value, middle, limits).select(
        *group, ((F.col("_low") + F.col("_high")) / 2.0).alias(name), "n"
    )
