"""Near duplicates by a chosen-path set similarity join (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm import words as w
from rollscale.llm.common import body, documents, in_python, joined, mix, slices, stored, texts
from rollscale.llm.components import components
from rollscale.session import ship_package

#: Independent trees, and the minwise tokens that each node of a tree branches by.
TREES, BRANCHES = 6, 2
#: Nodes of at most LEAF documents are compared exhaustively; larger ones branch, down to DEPTH.
LEAF, DEPTH = 3000, 3
#: Minwise values of a sketch, a byte each. A pair at the threshold falls below the margin with a
#: chance of about 2e-7 (five standard deviations).
VALUES = 128
MARGIN = 0.18
#: Sets and bytes of a chunk, as dealt by hash: a comparison holds a chunk of a larger group and, in
#: the second round, a block of questions of the same size.
CHUNK, CHUNK_BYTES = 4096, 48 << 20
PIVOTS = 8
#: Counters of the order by which sets of large groups are filtered.
COUNTERS = 1 << 16

_MULTIPLIERS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(w.STEP)) | np.uint64(1)
_MASKS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_EDGES = "a binary, b binary"


def _set_of(text: str, width: int) -> np.ndarray:
    return w.shingles(text.encode().lower().split(), width)


def _key(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def _minwise(members: np.ndarray) -> np.ndarray:
    best = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 2048):
        part = members[at : at + 2048]
        value = (part[None, :] ^ _MASKS[:, None]) * _MULTIPLIERS[:, None]
        np.minimum(best, value.min(1), out=best)
    return mix(best)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, print (of the text), n_shingles, key (hash of the whole set), sketch and the tokens
    of the first level."""
    first = TREES * BRANCHES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size, key, sketch, tokens = [], [], [], []
            for text in texts(batch):
                members = _set_of(text, width)
                size.append(len(members))
                key.append(_key(members))
                if len(members):
                    least = _minwise(members)
                    sketch.append((least & np.uint64(0xFF)).astype(np.uint8).tobytes())
                    tokens.append(least[:first].view(np.int64).tolist())
                else:
                    sketch.append(b"")
                    tokens.append([])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("print"),
                    pa.array(size, pa.int64()),
                    pa.array(key, pa.binary()),
                    pa.array(sketch, pa.binary()),
                    pa.array(tokens, pa.list_(pa.int64())),
                ],
                ["doc_id", "print", "n_shingles", "key", "sketch", "tokens"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(body()).alias("print"),
        body().alias("text"),
    )
    return in_python(
        rows,
        work,
        "doc_id long, print long, n_shingles long, key binary, sketch binary, tokens array<bigint>",
    )


class _Groups:
    """Sets of rows that are known to be one."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.left = n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.left -= 1
        return True


def _by_sketch(payload: list[bytes], known: _Groups, ask: np.ndarray, similarity: float):
    """Pairs whose sketches agree enough, without those that earlier pairs connect."""
    rows = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1)
    need = (similarity - MARGIN) * rows.shape[1]
    for i in np.flatnonzero(ask):
        if known.left == 1:
            return
        alike = (rows == rows[i]).sum(1)
        for j in np.flatnonzero(alike >= need):
            if j != i and known.join(int(i), int(j)):
                yield int(i), int(j)


def _by_set(payload: list[bytes], known: _Groups, ask: np.ndarray, similarity: float):
    """Pairs of similar sets, counted exactly through the shingles' lists of documents."""
    sizes = np.array([len(p) // 8 for p in payload])
    members = np.frombuffer(b"".join(payload), np.uint64)
    _, number, times = np.unique(members, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(payload)), sizes)[np.argsort(number, kind="stable")]
    ends = np.cumsum(times)
    starts = np.cumsum(sizes) - sizes
    limit = round(similarity * 100)
    for i in np.flatnonzero(ask):
        if known.left == 1:
            return
        own = number[starts[i] : starts[i] + sizes[i]]
        own = own[times[own] > 1]
        if not len(own):
            continue
        n = times[own]
        base = np.repeat(ends[own] - np.cumsum(n), n)
        shared = np.bincount(owner[base + np.arange(n.sum())], minlength=len(payload))
        alike = 100 * shared >= limit * (sizes[i] + sizes - shared)
        for j in np.flatnonzero(alike):
            if j != i and known.join(int(i), int(j)):
                yield int(i), int(j)


def _compare(dealt: DataFrame, pairs, similarity: float) -> DataFrame:
    """Edges within each leaf. Rows: bucket, leaf, key, label (known component), ask, payload;
    leaves of one bucket are in memory together."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leaf", "ascending"), ("key", "ascending")])
        leaf = table.column("leaf").to_numpy()
        key, label = table.column("key").to_pylist(), table.column("label").to_pylist()
        payload, ask = table.column("payload").to_pylist(), table.column("ask").to_numpy()
        a, b = [], []
        cut = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        for i, j in zip(cut, np.append(cut[1:], len(leaf)), strict=True):
            # A row can be here twice, as a member and as a pivot or a question.
            place: dict[bytes, int] = {}
            for r in range(i, j):
                if (p := place.setdefault(key[r], r)) != r:
                    ask[p] |= ask[r]
            rows = list(place.values())
            if len(rows) < 2:
                continue
            known, by_label = _Groups(len(rows)), {}
            for n, r in enumerate(rows):
                if label[r] is not None:
                    known.join(n, by_label.setdefault(label[r], n))
            found = pairs([payload[r] for r in rows], known, ask[rows], similarity)
            for x, y in found:
                a.append(key[rows[x]])
                b.append(key[rows[y]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(work, _EDGES)


def _chunks(payload: str) -> F.Column:
    """The chunks of a group, by its sets and their bytes."""
    return F.greatest(
        F.ceil(F.count("*") / F.lit(CHUNK)),
        F.ceil(F.sum(F.length(payload).cast("long")) / F.lit(CHUNK_BYTES)),
        F.lit(1).cast("long"),
    )


def links(rows: DataFrame, pairs, similarity: float, parts: int, sizes: DataFrame) -> DataFrame:
    """Edges that connect all similar keys of each group. rows: group, key, payload.

    sizes has group and chunks. A group of one chunk is one leaf. A larger one is dealt into
    chunks, each with some common pivots, and joined up; then only keys outside the group's
    largest component are compared once more: they are dealt into blocks like chunks, and every
    block meets every chunk in a leaf and a task of its own, so no pair is missed, pairs inside the
    large component are never formed, and no leaf holds more than a chunk and a block.
    """
    sized = joined(rows, sizes, "group").withColumn(
        "chunk", F.pmod(F.xxhash64("key", "group"), F.col("chunks"))
    )
    leaf = F.xxhash64("group", "chunk")
    bucket = F.when(F.col("chunks") > 1, leaf).otherwise(F.pmod(leaf, F.lit(8 * parts)))
    blank = F.lit(None).cast("binary").alias("label")
    whole = [bucket.alias("bucket"), leaf.alias("leaf"), "key", blank]
    whole += [F.lit(True).alias("ask"), "payload"]
    plain = sized.select(*whole)
    if sizes.where("chunks > 1").isEmpty():
        return _compare(plain, pairs, similarity)
    large = stored(sized.where("chunks > 1"), "large-groups")
    pivots = large.where(
        F.pmod(F.xxhash64(F.lit(7), "key", "group"), F.col("chunks") * F.lit(CHUNK))
        < F.lit(PIVOTS)
    ).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    first = stored(
        _compare(plain.union(pivots.select(*whole)), pairs, similarity),
        "links",
    )
    labelled = joined(large, components(first), "key", "left").withColumn(
        "label", F.coalesce("label", "key")
    )
    labelled = stored(labelled, "labelled-groups")
    main = (
        labelled.groupBy("group", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("group")
        .agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    )
    judged = joined(labelled, main, "group").withColumn("ask", F.col("label") != F.col("main"))
    blocks = judged.where("ask").groupBy("group").agg(_chunks("payload").alias("blocks"))
    judged = joined(judged, stored(blocks, "question-blocks"), "group")
    asked = judged.where("ask").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(11), "key", "group"), F.col("blocks"))
    )
    asked = asked.withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    )
    judged = judged.withColumn("ask", F.lit(False)).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    leaf = F.xxhash64("group", "chunk", "block")
    columns = [leaf.alias("bucket"), leaf.alias("leaf"), "key", "label", "ask", "payload"]
    again = judged.select(*columns).union(asked.select(*columns))
    return first.union(_compare(again, pairs, similarity))


def filtered(rows: DataFrame, sizes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """rows (group, key, payload) and sizes, the groups of several chunks cut into finer ones.

    Of two sets of at least the similarity s, the smaller has one of its first
    n - ceil(2 * s / (1 + s) * n) + 1 members among the first n - ceil(s * n) + 1 of the larger,
    whatever order both follow. The order is rarest first, by a table of COUNTERS hashed counts, so
    what templates share comes last. Only sets that such members connect stay together; those
    without company have no similar set and leave. Linear in the members.
    """
    large = sizes.where("chunks > 1").select("group")
    if large.isEmpty():
        return rows, sizes
    many = stored(joined(rows, large, "group"), "filtered-groups")
    limit = round(similarity * 100)

    def place(members: np.ndarray) -> np.ndarray:
        return (mix(members) % np.uint64(COUNTERS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for p in batch.column("payload"):
                members = np.frombuffer(p.as_buffer(), np.uint64)
                total += np.bincount(place(members), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["at", "n"]
        )

    told = in_python(many.select("payload"), count, "at long, n long")
    counts = np.zeros(COUNTERS, np.int64)
    for r in told.groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            firsts, short, long, size = [], [], [], []
            for p in batch.column("payload"):
                members = np.frombuffer(p.as_buffer(), np.uint64)
                n = len(members)
                order = np.lexsort((members, counts[place(members)]))
                long.append(n + limit * n // -100 + 1)
                short.append(n + 2 * limit * n // -(100 + limit) + 1)
                size.append(n)
                firsts.append(members[order[: long[-1]]].view(np.int64))
            at = np.repeat(np.arange(len(firsts)), long)
            rank = np.arange(len(at)) - np.repeat(np.cumsum(long) - long, long)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("group").take(pa.array(at)),
                    batch.column("key").take(pa.array(at)),
                    pa.array(np.concatenate(firsts), pa.int64()),
                    pa.array(np.array(size)[at], pa.int64()),
                    pa.array(rank < np.array(short)[at]),
                ],
                ["group", "key", "member", "size", "early"],
            )

    firsts = in_python(
        many.select("group", "key", "payload"),
        begin,
        "group binary, key binary, member long, size long, early boolean",
    )
    firsts = stored(
        firsts.select(_node("group", "member"), "key", "size", "early"), "first-members"
    )
    # All that must meet at a node does so through its smallest early set.
    heads = firsts.where("early").groupBy("node").agg(F.min(F.struct("size", "key")).alias("head"))
    met = joined(firsts, heads, "node").where("size >= head.size AND key <> head.key")
    met = met.select(F.col("key").alias("a"), F.col("head.key").alias("b"))
    finer = joined(many.drop("group"), components(met), "key")
    finer = stored(finer.select(F.col("label").alias("group"), "key", "payload"), "finer-groups")
    few = joined(rows, large, "group", "left_anti").select("group", "key", "payload")
    chunks = finer.groupBy("group").agg(_chunks("payload").alias("chunks"))
    return few.union(finer), stored(
        sizes.where("chunks = 1").union(chunks.select("group", "chunks")), "finer-sizes"
    )


def _node(*parts) -> F.Column:
    return F.xxhash64(*parts).alias("node")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (node, key) of nodes with company, and the node's size."""
    sizes = stored(
        rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node-sizes"
    )
    return stored(joined(rows, sizes, "node"), "nodes")


def candidates(sets: DataFrame, similarity: float, parts: int) -> DataFrame:
    """Edges that connect all sets whose sketches agree enough, found in the trees' leaves."""
    rows = sets.select("key", F.posexplode("tokens").alias("tree", "token")).select(
        _node("tree", "token"), "key"
    )
    leaves = []
    for level in range(1, DEPTH + 1):
        sized = _counted(rows)
        last = level == DEPTH or sized.where(F.col("n") > LEAF).isEmpty()
        leaves.append(sized if last else sized.where(F.col("n") <= LEAF))
        if last:
            break
        branch = F.posexplode(F.array(*(F.lit(b) for b in range(BRANCHES))))
        rows = (
            joined(sized.where(F.col("n") > LEAF), sets.select("key", "sketch"), "key")
            .select("key", "sketch", "node", branch.alias("b", "_"))
            .withColumn("at", F.pmod(F.xxhash64("node", "b"), F.lit(VALUES)).cast("int"))
            .select(_node("node", "b", F.substring("sketch", F.col("at") + 1, F.lit(1))), "key")
        )
    members = leaves[0]
    for more in leaves[1:]:
        members = members.union(more)
    sizes = members.groupBy("node").agg(F.first("n").alias("n"))
    sizes = stored(
        sizes.select(
            F.col("node").alias("group"), F.ceil(F.col("n") / F.lit(CHUNK)).alias("chunks")
        ),
        "leaf-sizes",
    )
    rows = joined(members, sets.select("key", "sketch"), "key").select(
        F.col("node").alias("group"), "key", F.col("sketch").alias("payload")
    )
    return links(rows, _by_sketch, similarity, parts, sizes)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """group, key and payload (the full set) for the wanted rows (doc_id, print, key, group).

    Rows are met by id and text hash, so those that share an id, or have none, do not multiply.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(
                batch.column("group").to_pylist(),
                batch.column("key").to_pylist(),
                (_set_of(t, width) for t in texts(batch)),
                strict=True,
            )
            # Different texts may share id and hash: only the one with this key counts.
            rows = [(g, k, s.tobytes()) for g, k, s in rows if _key(s) == k]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                ["group", "key", "payload"],
            )

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(body()).alias("print"),
        body().alias("text"),
    )
    same = named["doc_id"].eqNullSafe(wanted["doc_id"]) & (named["print"] == wanted["print"])
    rows = joined(named, wanted, same)
    rows = rows.select("group", "key", "text")
    return in_python(rows, work, "group binary, key binary, payload binary")


def classes(
    docs: DataFrame, similarity: float = 0.8, width: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(documents with their set's key and size, sets with the label and the smallest doc_id of
    their class).

    Documents with the same set fold into one at once. A set follows, in TREES trees, the nodes of
    its minwise tokens; a node with more than LEAF sets branches again by BRANCHES tokens of each
    node. Sets in a leaf whose sketches agree form candidate edges, only as many as connect them.
    Components of these are then settled on full sets, those of several chunks after a filter of
    their first members: intersections are counted exactly and again only connecting links are
    kept. Full sets move once, of large components once more for each block or chunk they meet. A pair at the threshold meets in
    a small node with a chance of 1 - 0.2 ^ 12, in a deep one of 1 - 0.0625 ^ 6.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = stored(sketches(docs, width), "sketches")
    sets = stored(
        each.where("n_shingles > 0")
        .groupBy("key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "print")).alias("one"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
            F.first("tokens").alias("tokens"),
        )
        .select("key", "one.doc_id", "one.print", "n_shingles", "sketch", "tokens"),
        "sets",
    )
    edges = stored(candidates(sets, similarity, parts), "candidates")
    grouped = stored(
        joined(sets, components(edges), "key").select(
            "doc_id", "print", "key", "n_shingles", F.col("label").alias("group")
        ),
        "candidate-groups",
    )
    weight = F.greatest(
        F.ceil(F.count("*") / F.lit(CHUNK)),
        F.ceil(F.sum("n_shingles") * 8 / F.lit(CHUNK_BYTES)),
    )
    sizes = stored(grouped.groupBy("group").agg(weight.alias("chunks")), "group-sizes")
    payload = stored(
        full_sets(docs, grouped.select("doc_id", "print", "key", "group"), width).dropDuplicates(["key"]),
        "full-sets",
    )
    payload, sizes = filtered(payload, sizes, similarity)
    exact = stored(links(payload, _by_set, similarity, parts, sizes), "exact-links")
    labelled = joined(sets.select("key", "doc_id"), components(exact), "key", "left")
    labelled = labelled.select("key", "doc_id", F.coalesce("label", "key").alias("label"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = stored(joined(labelled, least, "label").select("key", "label", "component_id"), "classes")
    return each.select("doc_id", "print", "n_shingles", "key"), found


def assign(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Words are split at white space, A-Z lower-cased; a set holds the distinct runs of `width`
    words, of a shorter text its whole sequence. Sets with intersection / union of at least
    `similarity` are linked; component_id is the smallest doc_id reachable. Null, empty and
    wordless texts have no set, link with nothing and stay. Rows without a doc_id take part, but
    give no component id unless a row with one is reached; their own kept is false then, and null
    stays their component. Repeated rows share a set, so they are one component. An empty table
    gives no rows; other columns are unread.
    """
    each, found = classes(docs, similarity, width)
    return joined(each, found, "key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id"))
        .otherwise(F.col("doc_id"))
        .alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("doc_id").eqNullSafe(F.col("component_id")))
        .otherwise(True)
        .alias("kept"),
    )


def deduplicate(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of docs for each class, with all its columns: the one with the smallest doc_id, of
    rows with that id the smallest by text hash, of repeated rows the first.

    Rows without words (null and empty texts too) all stay; a class without any id keeps its row
    with the smallest text hash. Columns of any type are kept, maps too; no rows give no rows.
    """
    each, found = classes(docs, similarity, width)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("print"))
    firsts = each.where("n_shingles > 0").groupBy("key").agg(F.min(order).alias("best"))
    kept = (
        joined(firsts, found, "key")
        .groupBy("label")
        .agg(F.min("best").alias("best"))
        .select(
            F.coalesce(F.col("best.doc_id").cast("string"), F.lit("null")).alias("id"),
            F.col("best.print").alias("print"),
        )
    )
    word = body().rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(word).select(
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("id"),
        F.xxhash64(body()).alias("print"),
        F.monotonically_increasing_id().alias("at"),
        F.struct(*docs.columns).alias("row"),
    )
    one = joined(rows, kept, ["id", "print"]).groupBy("id", "print")
    one = one.agg(F.min_by("row", "at").alias("row"))
    return one.select("row.*").unionByName(docs.where(~word))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir), width=4)


SQL = None
