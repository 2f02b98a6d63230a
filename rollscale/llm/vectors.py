"""Rows of embeddings that can take part, and their numpy form inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one numpy step, whatever the size of an Arrow batch.
ROWS = 8192


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def finite(df: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows whose vector holds neither null, NaN nor infinity.

    All vectors of a computation need one length: rows whose length is not the commonest (of
    equally common ones, the longest) take no part, nor do empty vectors.
    """
    rows = df.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).where(
        (F.size("vector") > 0)
        & F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    )
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    width = sizes.agg(F.max(F.struct("n", "width")).alias("most")).first()["most"]
    return rows.where(F.size("vector") == (width["width"] if width else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(-1)
    offsets = np.arange(0, flat.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def steps(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)
