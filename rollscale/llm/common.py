"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.session import scratch_path, ship_package

#: The white space of every word and line rule here, as a regular expression class and as text.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides at every size: neither has a bound, and large keys can be
    split when both come from plain exchanges."""
    return left.join(right.hint("merge"), on, how)


def body(text: str = "text") -> Column:
    """The text, a null counted as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, upper, upper.lower())).otherwise(
        F.lower(c)
    )


def in_python(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on every executor."""
    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds some megabytes of text or one longer row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends = np.cumsum(sizes.astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the constants of the published splitmix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo:
    """Values that a worker remembers over tasks: two generations of at most `size` keys and those
    of one slice, so frequent keys survive and memory stays bounded."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys) -> list:
        """The keys without a value; the others are at hand in `young` until the next call."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if (v := old.get(k)) is None:
                    out.append(k)
                else:
                    young[k] = v
        return out


_STATE: list = [None, None]


def remembered(key, make):
    """What this worker process made last under this key; making another thing drops it, so a
    worker that serves several operators holds the memory of one."""
    if _STATE[0] != key:
        _STATE[:] = [None, None]
        _STATE[:] = [key, make()]
    return _STATE[1]
