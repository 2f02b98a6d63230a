"""Exact repeats of long word runs by fixed-block anchors (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm import words as w
from rollscale.llm.common import body, documents
from rollscale.session import ship_package

WINDOW = 35
#: Bits of a block hash inside its bucket; two more hold flags.
KEPT_BITS = 30
#: Document batches for each shuffle partition.
FINER = 2
_PARCEL = "bucket long, batch long, data binary"


def _block(window: int) -> int:
    """The longest block such that every window has a whole one at a multiple of its length."""
    return (window + 1) // 2


class Batch:
    """The words of a batch's documents, one after another."""

    def __init__(self, table: pa.Table, window: int):
        self.table, self.window = table, window
        texts = (t.as_py() or "" for t in table.column("text"))
        self.hashes, counts = [], []
        for text in texts:
            words = text.encode().split()
            counts.append(len(words))
            if len(words) >= window:
                self.hashes.append(w.hashes(words))
        self.counts = np.array(counts, np.int64)
        self.long = np.flatnonzero(self.counts >= window)
        sizes = self.counts[self.long]
        self.h = np.concatenate(self.hashes) if self.hashes else np.zeros((0, 2), np.uint64)
        self.hashes = []
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def runs(self, width: int, half: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the run at each position, and whether the run stays in its document."""
        out = w.rolling(np.ascontiguousarray(self.h[:, half]), width)
        room = np.repeat(self.ends, self.ends - self.starts)[: len(out)] - np.arange(len(out))
        return out, room >= width

    def offsets(self, n: int) -> np.ndarray:
        return np.arange(n) - np.repeat(self.starts, self.ends - self.starts)[:n]

    def blocks(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Short hash of each rolling block, whether it is whole, whether it is a reference."""
        block = _block(self.window)
        full, whole = self.runs(block)
        short = full >> np.uint64(64 - bits - KEPT_BITS)
        return short, whole, whole & (self.offsets(len(full)) % block == 0)


def _parcels(bucket: np.ndarray, cut: np.ndarray, batch: int, make) -> pa.Table:
    """A row per bucket; bucket is sorted, cut holds the first position of each."""
    ends = _ends(cut, len(bucket))
    return pa.table(
        {
            "bucket": pa.array(bucket[cut].astype(np.int64), pa.int64()),
            "batch": pa.array([batch] * len(cut), pa.int64()),
            "data": pa.array([make(a, b) for a, b in zip(cut, ends, strict=True)], pa.binary()),
        }
    )


def _cuts(x: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _ends(cut: np.ndarray, total: int) -> np.ndarray:
    return np.append(cut[1:], total) if len(cut) else cut


def _offer_blocks(table: pa.Table, window: int, bits: int) -> pa.Table:
    """Distinct rolling blocks of the batch: is it there twice, is it a reference block."""
    batch = Batch(table, window)
    short, whole, anchor = batch.blocks(bits)
    marked = np.sort((short << np.uint64(1) | anchor.astype(np.uint64))[whole])
    short = marked >> np.uint64(1)
    first = _cuts(short)
    last = _ends(first, len(short)) - 1
    flags = (last > first).astype(np.uint64) << np.uint64(1) | marked[last] & np.uint64(1)
    short = short[first]
    packed = (((short & np.uint64(2**KEPT_BITS - 1)) << np.uint64(2)) | flags).astype(np.uint32)
    bucket = short >> np.uint64(KEPT_BITS)
    return _parcels(
        bucket, _cuts(bucket), _number(table), lambda a, b: w.squeeze(packed[a:b])
    )


def _number(table: pa.Table) -> int:
    return table.column("batch")[0].as_py() if table.num_rows else 0


def _answers(bucket: int, batch: np.ndarray, kept: np.ndarray, kind: type) -> pa.Table:
    """A row per batch with the sorted values it asked for that are shared."""
    order = np.lexsort((kept, batch))
    batch, kept = batch[order], kept[order].astype(kind)
    cut = _cuts(batch)
    ends = _ends(cut, len(batch))
    return pa.table(
        {
            "bucket": pa.array([bucket] * len(cut), pa.int64()),
            "batch": pa.array(batch[cut].astype(np.int64), pa.int64()),
            "data": pa.array(
                [w.squeeze(kept[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()
            ),
        }
    )


def _probe_blocks(table: pa.Table) -> pa.Table:
    """Blocks that equal a reference block and occur at a second place."""
    parts = [w.unsqueeze(d.as_py(), np.uint32) for d in table.column("data")]
    sizes = [len(p) for p in parts]
    value = np.concatenate(parts)
    batch = np.repeat(table.column("batch").to_numpy(), sizes)
    order = np.argsort(value >> np.uint32(2), kind="stable")
    value, batch = value[order], batch[order]
    short = value >> np.uint32(2)
    first = _cuts(short)
    times = np.diff(np.append(first, len(short)))
    anchor = np.maximum.reduceat(value & np.uint32(1), first) > 0
    twice = (times > 1) | (np.maximum.reduceat(value & np.uint32(2), first) > 0)
    take = np.repeat(anchor & twice, times)
    return _answers(_bucket(table), batch[take], short[take], np.uint32)


def _bucket(table: pa.Table) -> int:
    return table.column("bucket")[0].as_py()


def _offer_windows(table: pa.Table, hits: pa.Table, window: int, bits: int) -> pa.Table:
    """Extends hits: the batch's distinct windows that hold a shared block, by their full hash."""
    if not table.num_rows or not hits.num_rows:
        return pa.schema(
            [("bucket", pa.int64()), ("batch", pa.int64()), ("data", pa.binary())]
        ).empty_table()
    batch = Batch(table, window)
    shared = np.concatenate(
        [
            w.unsqueeze(d.as_py(), np.uint32).astype(np.uint64)
            | np.uint64(b.as_py()) << np.uint64(KEPT_BITS)
            for b, d in zip(hits.column("bucket"), hits.column("data"), strict=True)
        ]
    )
    short, whole, _ = batch.blocks(bits)
    hit = whole & np.isin(short, shared)
    seen = np.append(0, np.cumsum(hit))
    first, inside = batch.runs(window)
    second, _ = batch.runs(window, 1)
    at = np.arange(len(first))
    reach = window - _block(window) + 1
    some = inside & (seen[np.minimum(at + reach, len(hit))] > seen[at])
    a, b = first[some], second[some] >> np.uint64(33)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    differs = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    cut = np.flatnonzero(differs)
    twice = (_ends(cut, len(a)) - cut > 1).astype(np.uint32)
    a, b = a[cut], (b[cut].astype(np.uint32) << np.uint32(1)) | twice
    bucket = a >> np.uint64(64 - bits)

    def make(i, j):
        return w.squeeze(a[i:j]) + b[i:j].tobytes()

    return _parcels(bucket, _cuts(bucket), _number(table), make)


def _probe_windows(table: pa.Table) -> pa.Table:
    """Windows that occur at two places at least."""
    first, second, sizes = [], [], []
    for d in table.column("data"):
        data = d.as_py()
        n = len(data) // 12
        first.append(w.unsqueeze(data[: 8 * n], np.uint64))
        second.append(np.frombuffer(data[8 * n :], np.uint32))
        sizes.append(n)
    a, b = np.concatenate(first), np.concatenate(second)
    batch = np.repeat(table.column("batch").to_numpy(), sizes)
    order = np.lexsort((b >> np.uint32(1), a))
    a, b, batch = a[order], b[order], batch[order]
    word = b >> np.uint32(1)
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (word[1:] != word[:-1])))
    times = np.diff(np.append(cut, len(a)))
    twice = (times > 1) | (np.maximum.reduceat(b & np.uint32(1), cut) > 0)
    take = np.repeat(twice, times)
    return _answers(_bucket(table), batch[take], a[take], np.uint64)


def _remove(table: pa.Table, hits: pa.Table, window: int) -> pa.Table:
    """Drops the words that repeated windows cover."""
    batch = Batch(table, window)
    removed = np.zeros(len(batch.counts), np.int64)
    covered = np.zeros(len(batch.h), bool)
    if hits.num_rows and len(batch.h):
        shared = np.concatenate(
            [w.unsqueeze(d.as_py(), np.uint64) for d in hits.column("data")]
        )
        first, inside = batch.runs(window)
        at = np.flatnonzero(inside & np.isin(first, shared))
        change = np.zeros(len(batch.h) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        covered = np.cumsum(change[:-1]) > 0
    texts = []
    place = dict(zip(batch.long.tolist(), range(len(batch.long)), strict=True))
    for row, t in enumerate(table.column("text")):
        words = (t.as_py() or "").encode().split()
        if (k := place.get(row)) is not None:
            gone = covered[batch.starts[k] : batch.ends[k]]
            removed[row] = int(gone.sum())
            if removed[row]:
                words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
        texts.append(b" ".join(words).decode())
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "text": pa.array(texts, pa.string()),
            "n_words": pa.array(batch.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
        }
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (words that stay, joined by a space), n_words and n_removed of every row.

    A word goes if a run of `window` words over it also starts anywhere else, in any document;
    runs are judged on the input. Every window holds a whole reference block (blocks do not
    overlap), so a repeat makes a rolling block of the other place meet it. Three steps, each over
    batches of documents: batches offer their distinct rolling blocks by hash and learn which are
    shared reference blocks; they extend those hits to full windows, offer the distinct ones by a
    95-bit hash and learn which occur twice; they drop what these cover. A short block hash only
    adds candidates. A batch sends a value once, so a passage of a third of all documents costs
    one entry per batch and no pairs are made. Documents move once, by the hash of id and text.

    Null and empty texts have no words; shorter texts than a window lose none; all white space
    between words becomes one space. Repeated rows are copies of each other, so all of their
    windows repeat. A null doc_id stays null; an empty table gives no rows; other columns are
    unread.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(2, (parts - 1).bit_length())
    ident = F.col("doc_id").cast("long")
    rows = (
        docs.select(ident.alias("doc_id"), body().alias("text"))
        .withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(FINER * parts)))
        .repartition(parts, "batch")
    )
    asked = rows.groupBy("batch").applyInArrow(lambda t: _offer_blocks(t, window, bits), _PARCEL)
    hits = asked.groupBy("bucket").applyInArrow(_probe_blocks, _PARCEL)
    wider = (
        rows.groupBy("batch")
        .cogroup(hits.groupBy("batch"))
        .applyInArrow(lambda t, h: _offer_windows(t, h, window, bits), _PARCEL)
    )
    repeats = wider.groupBy("bucket").applyInArrow(_probe_windows, _PARCEL)
    return (
        rows.groupBy("batch")
        .cogroup(repeats.groupBy("batch"))
        .applyInArrow(
            lambda t, h: _remove(t, h, window),
            "doc_id long, text string, n_words long, n_removed long",
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


SQL = None
