"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates (operator 8)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm.common import Memo, body, documents, in_python, mix, remembered, slices, texts

BITS = 15
#: Labelled rows that a fit reads at most, those with the smallest hash of their id.
MOST_ROWS = 4096
EPOCHS = 4
SEED = 0x9E3779B97F4A7C15
MEMO = 200_000


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of follow-the-regularised-leader."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 1.0


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _shape(word: bytes) -> bytes:
    """The word with each run of small, capital, other letters or digits as one character."""
    out = bytearray()
    for c in word:
        kind = (
            0x61 if 0x61 <= c <= 0x7A
            else 0x41 if 0x41 <= c <= 0x5A
            else 0x30 if 0x30 <= c <= 0x39
            else 0x62 if c >= 0x80
            else c
        )
        if not out or out[-1] != kind:
            out.append(kind)
    return bytes(out)


class Grams:
    """Hashed counts of a text's words and word pairs, as such and by their shapes.

    A pair of equal words has a shape feature of its own, so repetition shows in any language.
    """

    def __init__(self):
        self.memo = Memo(MEMO)

    def _word(self, word: bytes) -> bytes:
        return struct.pack("<QQ", _hash(word), _hash(b"\0" + _shape(word)))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers, and values that make a unit vector."""
        words = text.encode().split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        for w in self.memo.missing(set(words)):
            self.memo.young[w] = self._word(w)
        both = np.frombuffer(b"".join(map(self.memo.young.__getitem__, words)), "<u8")
        both = both.reshape(-1, 2)
        own, shape = both[:, 0], both[:, 1]
        same = (own[1:] == own[:-1]).astype(np.uint64)
        step, base = np.uint64(SEED), np.uint64(3)
        grams = np.concatenate(
            [
                mix(own),
                mix(shape + base),
                mix(own[:-1] * step + own[1:]),
                mix(shape[:-1] * step + shape[1:] + same),
                mix(same + np.uint64(7)),
            ]
        )
        n = np.bincount((grams >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        at = np.flatnonzero(n)
        value = np.log1p(n[at])
        return at, value / np.sqrt(value @ value)


def _grams() -> Grams:
    return remembered("grams", Grams)


def _label_bit(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The third of ids whose labels no fit sees. A null id is not held out."""
    return F.coalesce(_label_bit(doc_id) == 1, F.lit(False))


def train(rows: list[tuple[float, np.ndarray, np.ndarray]], rates: Ftrl) -> np.ndarray:
    """Weights, the last one the bias, by FTRL-proximal updates over the rows in turn."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        small = np.abs(z[at]) <= rates.l1
        w = -(z[at] - np.sign(z[at]) * rates.l1) / (
            (rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2
        )
        return np.where(small, 0.0, w)

    for _ in range(EPOCHS):
        for label, at, value in rows:
            at, value = np.append(at, size - 1), np.append(value, 1.0)
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            rate = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / rates.alpha
            z[at] += gradient - rate * w
            n[at] += gradient**2
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, rates: Ftrl = Ftrl(), most: int = MOST_ROWS):
    """Weights from at most `most` labelled rows outside the held-out third of ids.

    Rows without an id, a label or a document are no examples; no examples give zero weights.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    # Rows that share an id: only the one whose text has the smallest hash, so `most` bounds them.
    rows = rows.groupBy("doc_id").agg(
        F.first("quality").alias("quality"), F.min(F.struct(F.xxhash64("text"), "text")).alias("best")
    )
    rows = rows.select("doc_id", "quality", F.col("best.text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams()
        for batch in slices(batches):
            made = [grams(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("quality").cast(pa.int32()),
                    pa.array([a.astype("<i4").tobytes() for a, _ in made], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary()),
                ],
                ["doc_id", "quality", "at", "value"],
            )

    found = in_python(rows, work, "doc_id long, quality int, at binary, value binary").collect()
    found.sort(key=lambda r: (_hash(str(r["doc_id"]).encode()), bytes(r["at"])))
    return train(
        [
            (
                float(r["quality"]),
                np.frombuffer(r["at"], "<i4").astype(np.int64),
                np.frombuffer(r["value"], "<f4").astype(float),
            )
            for r in found
        ],
        rates,
    )


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with a column `score`: the chance of good quality, a sparse dot product per text.

    Null and empty texts get the score of the bias alone. Every row is scored, repeated ones alike;
    a null id stays null; only doc_id and text are read.
    """
    w = weights.astype(np.float32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams()
        for batch in slices(batches):
            logits = np.array([w[at] @ v for at, v in map(grams, texts(batch))]) + w[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))), pa.float64()),
                ],
                ["doc_id", "text", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return in_python(rows, work, "doc_id long, text string, score double")


def accept(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least the threshold, with all their columns."""
    w = weights.astype(np.float32)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams()
        for batch in slices(batches):
            logits = np.array([w[at] @ v for at, v in map(grams, texts(batch))]) + w[-1]
            yield batch.filter(pa.array(1 / (1 + np.exp(-logits)) >= threshold))

    return in_python(docs.select(*names), work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, weights).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


SQL = None
