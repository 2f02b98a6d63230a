"""Attach the columns of a one-row table as a scalar subquery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row of df next to the single row of `one_row`.

    The row is computed once and handed to the tasks as a constant; more than one
    row is an error.
    """
    names = one_row.columns
    record = one_row.select(F.struct(*names).alias("record")).scalar()
    return df.withColumn("_totals", record).select(
        *df.columns, *[F.col(f"_totals.{c}").alias(c) for c in names]
    )
