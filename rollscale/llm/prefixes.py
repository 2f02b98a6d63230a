"""Prefix trie of conversations from sorted turn-id matrices (operator 11).

A node is a distinct sequence of the first d turns; its members are the conversations that start
with it. Turns become ids, conversations rows of ids padded to the longest; sorted rows hold every
node as one run of rows, so sums over runs give all figures of a node. Rows are dealt in order to
shards; the few nodes that may reach beyond their shard are put together afterwards.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm.common import in_python, joined, stored

#: Turns of a shard, and how many leading turns order the conversations between shards.
SHARD_TURNS, LEAD = 400_000, 16
#: Columns of the padded matrix that are sorted at a time.
WIDE = 32
#: Bytes of a turn id, a prefix of the SHA-256 of role and text.
ID = 16
ROOT = bytes(ID)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(df: DataFrame) -> DataFrame:
    """conv_id and its turns (turn, id, bytes) in order: null turns first, equal ones by id."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return (
        df.where(F.col("conv_id").isNotNull())
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.struct(
                F.col("turn").cast("long").alias("turn"),
                F.substring(F.unhex(whole), 1, ID).alias("id"),
                F.octet_length(text).cast("long").alias("bytes"),
            ).alias("step"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("step")).alias("steps"))
    )


def rebuilt(own: DataFrame, every: int = 5, modulus: int = 9) -> DataFrame:
    """conv_id, ids and bytes: the first h turns of conversation c - c % every, then c's own turns
    after its first h; h = crc32(c) % modulus, fewer where the other has fewer."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    heads = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("steps", 1, modulus - 1).alias("head")
    )
    rows = own.withColumn("h", h.cast("int")).withColumn("base", F.expr(f"conv_id - conv_id % {every}"))
    whole = joined(rows, heads, "base", "left").select(
        "conv_id",
        F.concat(
            F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("steps", 1, 0)),
            F.slice("steps", F.col("h") + 1, F.size("steps")),
        ).alias("steps"),
    )
    return whole.select(
        "conv_id",
        F.col("steps.id").alias("ids"),
        F.col("steps.bytes").alias("bytes"),
    )


def turn_ids(raw: bytes) -> np.ndarray:
    """Dense numbers of the ids of all turns, in the order of the ids."""
    words = np.frombuffer(raw, ">u8").reshape(-1, ID // 8).astype(np.uint64)
    order = np.lexsort((words[:, 1], words[:, 0]))
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
    dense = np.empty(len(order), np.int64)
    dense[order] = np.cumsum(fresh) - 1
    return dense


def sorted_rows(turns: np.ndarray, first: np.ndarray, lengths: np.ndarray, conv: np.ndarray):
    """Row numbers in the order of their turn ids, then conv_id; a row before those that go on
    from it. Row r has turns[first[r] : first[r] + lengths[r]].

    Lexsort of the padded matrix, WIDE columns at a time: where rows agree in all columns so far,
    those with more turns are sorted by the next columns, until no two of them agree.
    """
    order = np.argsort(conv, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    places = np.flatnonzero(lengths[order] > 0)
    if len(places):  # rows without turns come first
        order = np.concatenate([order[lengths[order] == 0], order[places]])
        places = np.arange(len(order) - len(places), len(order))
    depth = 0
    while len(places):
        rows = order[places]
        column = depth + np.arange(WIDE)
        inside = column < lengths[rows][:, None]
        padded = np.where(inside, turns[np.where(inside, first[rows][:, None] + column, 0)], -1)
        more = lengths[rows] > depth + WIDE
        sort = np.lexsort((rank[rows], more, *padded.T[::-1], group[rows]))
        rows, padded, more = rows[sort], padded[sort], more[sort]
        order[places] = rows
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (padded[1:] != padded[:-1]).any(axis=1)
        fresh[1:] |= group[rows][1:] != group[rows][:-1]
        run = np.cumsum(fresh) - 1
        group[rows] = run
        alike = np.bincount(run[more], minlength=run[-1] + 1)[run] > 1
        places = places[more & alike]
        depth += WIDE
    return order


def levels(turns: np.ndarray, first: np.ndarray, lengths: np.ndarray, conv: np.ndarray, size: np.ndarray):
    """The nodes of sorted rows, one record of arrays for each depth from the root down.

    A row starts a node where its turn differs from that of the row before or where one further
    left does; these change masks, OR-accumulated over the columns, are the runs of the nodes.
    `reach` are the rows with a turn at this depth, `at` the places in reach where nodes start.
    """
    reach, run, depth = np.arange(len(conv)), np.zeros(len(conv), np.int64), 0
    at, parent, size_of = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        yield {
            "depth": depth,
            "reach": reach,
            "at": at,
            "parent": parent,
            "bytes": size_of,
            "n": np.add.reduceat(np.ones(len(reach), np.int64), at),
            "conv": np.minimum.reduceat(conv[reach], at),
            "ended": np.add.reduceat((lengths[reach] == depth).astype(np.int64), at),
        }
        going = lengths[reach] > depth
        reach, run = reach[going], run[going]
        if not len(reach):
            return
        turn = turns[first[reach] + depth]
        changed = np.ones(len(reach), bool)
        changed[1:] = (run[1:] != run[:-1]) | (turn[1:] != turn[:-1])
        at = np.flatnonzero(changed)
        parent, size_of = run[at], size[first[reach[at]] + depth]
        run = np.cumsum(changed) - 1
        depth += 1


def nodes(conv: np.ndarray, lengths: np.ndarray, raw: bytes, size: np.ndarray, shard: int):
    """Record batches of the nodes of one shard.

    Closed nodes have all their members here. Open ones may have more in other shards: those that
    hold the first or the last row and, as shards order rows by LEAD turns and conv_id only, all
    nodes below such a node of depth LEAD. For open nodes the sums over the subtree count closed
    nodes only, and `ends` lists the ids where closed nodes have the hash of the list.
    """
    first = np.cumsum(lengths) - lengths
    turns = turn_ids(raw)
    order = sorted_rows(turns, first, lengths, conv)
    conv, lengths, first = conv[order], lengths[order], first[order]
    trie = list(levels(turns, first, lengths, conv, size))
    edge = np.zeros(len(conv), bool)
    edge[[0, -1]] = True
    for k, level in enumerate(trie):
        if k <= LEAD:
            level["open"] = np.logical_or.reduceat(edge[level["reach"]], level["at"])
        else:
            level["open"] = trie[k - 1]["open"][level["parent"]]
        level["children"] = np.zeros(len(level["at"]), np.int64)
        if k:
            shut = level["parent"][~level["open"]]
            trie[k - 1]["children"] += np.bincount(shut, minlength=len(trie[k - 1]["at"]))
    # Every node weighs on its first row; a subtree is what weighs on the run of its top.
    saved, leaves = np.zeros(len(conv), np.int64), np.zeros(len(conv), np.int64)
    for level in reversed(trie):
        top, shut = level["reach"][level["at"]], ~level["open"]
        saved[top] += np.where(shut, (level["n"] - 1) * level["bytes"], 0)
        leaves[top] += shut & (level["children"] == 0)
        level["saved"] = np.add.reduceat(saved[level["reach"]], level["at"])
        level["leaves"] = np.add.reduceat(leaves[level["reach"]], level["at"])
    above, keys = None, []
    for level in trie:
        parent, opened = level["parent"], level["open"]
        over = [None] * len(parent) if above is None else [keys[p] for p in parent.tolist()]
        keys = [ROOT if above is None else None] * len(parent)
        if above is not None:
            ids = first[level["reach"][level["at"]]] + level["depth"] - 1
            for i in np.flatnonzero(opened).tolist():
                own = raw[ID * int(ids[i]) : ID * int(ids[i]) + ID]
                keys[i] = hashlib.sha256(over[i] + own).digest()[:ID]
        known = np.zeros(len(parent), bool) if above is None else ~above["open"][parent]
        conv_above = level["conv"] if above is None else above["conv"][parent]
        yield pa.record_batch(
            [
                pa.array(np.full(len(parent), shard), pa.int32()),
                pa.array(opened),
                pa.array(keys, pa.binary()),
                pa.array(over, pa.binary()),
                pa.array(np.full(len(parent), level["depth"]), pa.int64()),
                pa.array(level["conv"]),
                pa.array(conv_above, mask=~known),
                pa.array(level["n"]),
                pa.array(level["children"]),
                pa.array(level["leaves"]),
                pa.array(level["saved"]),
                pa.array(level["bytes"].astype(np.int64)),
                pa.array(_ends(level, conv, lengths), pa.string()),
            ],
            names=[f.split()[0] for f in NODE.split(", ")],
        )
        above = level


def _ends(level: dict, conv: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Rows that end at a node are the first of its run, in the order of their ids."""
    out = []
    for start, many, opened in zip(
        level["at"].tolist(), level["ended"].tolist(), level["open"].tolist(), strict=True
    ):
        ids = ",".join(map(str, conv[level["reach"][start : start + many]].tolist())) if many else ""
        out.append(ids if opened else hashlib.sha256(ids.encode()).hexdigest() if ids else NO_ENDS)
    return out


NODE = (
    "shard int, open boolean, key binary, parent_key binary, depth long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "bytes long, ends string"
)


def _shard(batches):
    columns = [(b.column("conv_id"), b.column("ids"), b.column("bytes")) for b in batches]
    if not any(len(c[0]) for c in columns):
        return
    conv, ids, size = (pa.concat_arrays(c) for c in zip(*columns, strict=True))
    yield from nodes(
        conv.to_numpy(zero_copy_only=False),
        ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
        b"".join(ids.flatten().to_pylist()),
        size.flatten().to_numpy(zero_copy_only=False),
        TaskContext.get().partitionId(),
    )


def _hashed(batches):
    """One hash per key over texts that come in order; the state of one key is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.record_batch([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def subtree_sums(tops: DataFrame) -> DataFrame:
    """key with the sums of weight and leaf over the node and all nodes below it, from (key, above,
    depth, weight, leaf). Pointers double: a round adds what lies 1, 2, 4, ... levels below, so the
    rounds grow with the logarithm of the depth."""
    deepest = tops.agg(F.max("depth")).first()[0] or 0
    state = tops.select("key", "above", "weight", "leaf")
    step = 1
    while step <= deepest:
        below = (
            state.where("above IS NOT NULL")
            .groupBy(F.col("above").alias("key"))
            .agg(F.sum("weight").alias("more_weight"), F.sum("leaf").alias("more_leaf"))
        )
        jump = state.select(F.col("key").alias("above"), F.col("above").alias("next"))
        state = stored(
            joined(joined(state, below, "key", "left"), jump, "above", "left").select(
                "key",
                F.col("next").alias("above"),
                (F.col("weight") + F.coalesce("more_weight", F.lit(0))).alias("weight"),
                (F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("leaf"),
            ),
            "trie-sums",
        )
        step *= 2
    return state.select("key", "weight", "leaf")


def trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node from conv_id, ids and bytes (see rebuilt): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Rows go to shards by range of their first LEAD turns and conv_id, so the copies of a hot
    conversation, or all that share a first turn, spread over many shards. Shards send closed
    nodes as they are; open ones, at most two paths of a shard and what lies below them past LEAD
    turns, are added up by key. Two sequences are one node if the 128-bit hashes of their turns
    agree. A conversation is one row of a shard: its ids must fit in a task. The ids that end at
    an open node meet as one text per shard, in order, and are hashed as a stream. No rows, no
    nodes, not even the root.
    """
    total = rows.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(1, math.ceil(total / shard_turns))
    dealt = rows.withColumn("lead", F.slice("ids", 1, LEAD)).repartitionByRange(shards, "lead", "conv_id")
    found = stored(in_python(dealt.select("conv_id", "ids", "bytes"), _shard, NODE), "trie-nodes")
    parts = found.where("open")
    tops = stored(
        parts.groupBy("key", "parent_key", "depth", "bytes").agg(
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        ),
        "trie-open",
    )
    children = tops.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    counted = joined(tops, children, "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))
    )
    weighed = stored(
        counted.select(
            "key",
            F.col("parent_key").alias("above"),
            "depth",
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("weight"),
            (F.col("n_children") == 0).cast("long").alias("leaf"),
        ),
        "trie-weights",
    )
    ends = (
        parts.where("ends <> ''")
        .select("key", "shard", "ends")
        .repartition("key")
        .sortWithinPartitions("key", "shard")
    )
    ends = in_python(ends, _hashed, "key binary, ends_sha256 string")
    names = tops.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    whole = joined(joined(joined(counted, subtree_sums(weighed), "key"), ends, "key", "left"), names, "parent_key", "left")
    whole = whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("weight")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    # Closed nodes under an open one learn its conv_id by shard and key, so the children of the
    # root are as many groups as there are shards.
    by_shard = joined(parts.select("shard", F.col("key").alias("parent_key")), names, "parent_key")
    under = joined(
        found.where("NOT open AND parent_key IS NOT NULL").drop("parent_conv_id"),
        by_shard,
        ["shard", "parent_key"],
    )
    columns = [*whole.columns[:-1], F.col("ends").alias("ends_sha256")]
    closed = found.where("NOT open AND parent_key IS NULL").select(*columns)
    return whole.unionByName(closed).unionByName(under.select(*columns))


def build(df: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie (see trie) of the rebuilt conversations of a table of turns (conv_id, turn, role,
    text). A null role or text is empty; null turns come first, equal turns of a conversation in
    the order of their ids, repeated rows as often as they stand there. Rows without a conv_id
    take no part; other columns are not read."""
    return trie(stored(rebuilt(conversations(df)), "conversations"), shard_turns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
           list_prepend(4294967295::BIGINT,
                        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, x: list_reduce(
             list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::BIGINT) ELSE b >> 1 END)),
           4294967295::BIGINT) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text
  FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
p AS (
  SELECT c.conv_id,
         coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY part, pos)
                    FILTER (part IS NOT NULL), []) AS path,
         coalesce(list(strlen(text) ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS sizes
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (
  SELECT conv_id, d, path[1:d] AS node, CASE WHEN d > 0 THEN path[1:d - 1] END AS up,
         CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, len(path) = d AS ends
  FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM p)),
n AS (
  SELECT node, d, up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM m GROUP BY node, d, up),
k AS (SELECT up AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY up),
w AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (node)),
s AS (
  SELECT node[1:e] AS node, count(*) FILTER (kids = 0) AS leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM w) GROUP BY node[1:e])
SELECT w.conv_id, w.d AS depth, o.conv_id AS parent_conv_id, w.n_convs, w.kids AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN s USING (node) LEFT JOIN n AS o ON o.node = w.up
"""
