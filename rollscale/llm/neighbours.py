"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 12).

Largest inner products become least distances by one more coordinate: sqrt(M^2 - |x|^2) for a row,
0 for a query scaled to length M, M being the longest row. Each of TABLES tables cuts random
(Gaussian, hence 2-stable) projections into cells; a bucket is a tuple of cells.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollscale.llm.common import in_python, mix, stored
from rollscale.llm.vectors import embeddings, finite, lists, matrix
from rollscale.session import broadcast_within

TABLES = 2
#: Width of a cell, in standard deviations of the projected rows.
CELL = 2.5
#: Rows that a bucket should hold; functions are added until it does, up to this many.
BUCKET, FUNCTIONS = 256, 8
#: Rows of a block, the unit that a task searches exhaustively for the queries that probe it.
BLOCK = 2048
#: Bounds of the samples of the fit: rows for the cell widths, queries for the number of probes.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 256
#: Share of the sampled queries' true neighbours that the probed buckets must hold.
TARGET = 0.95
SEED = 12
#: Queries whose best rows a task holds before it sends them on, and queries of one numpy step.
HELD, STEP = 50_000, 512
#: Largest table of crowded groups that is broadcast.
CROWDED = 500_000
NO_ID = 2**63 - 1


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1))
    if query:
        return np.column_stack([x * (longest / length)[:, None], np.zeros(len(x))])
    return np.column_stack([x, np.sqrt(np.maximum(longest**2 - length**2, 0.0))])


@dataclass(frozen=True)
class Index:
    """axes, offsets and cell widths of every table, and how many buckets a query visits."""

    longest: float
    axes: np.ndarray  # (table, width + 1, functions)
    offsets: np.ndarray  # (table, functions), in cells
    cells: np.ndarray  # (table, functions)
    probes: int = 1

    def places(self, x: np.ndarray, table: int, query: bool = False) -> np.ndarray:
        """Projections in units of cells."""
        flat = lifted(x, self.longest, query) @ self.axes[table]
        return flat / self.cells[table] + self.offsets[table]

    def moves(self) -> np.ndarray:
        """All perturbations by one cell at most in each function."""
        m = self.axes.shape[2]
        return np.array(list(itertools.product((-1, 0, 1), repeat=m)), np.int64).reshape(3**m, m)

    def costs(self, places: np.ndarray) -> np.ndarray:
        """(query, perturbation): squared distances to the cells entered, the estimate of how
        unlikely it is that a neighbour lies there."""
        within = places - np.floor(places)
        m = self.axes.shape[2]
        out = np.zeros((len(places), 1))
        for i in range(m):  # in the order of moves(): the last function changes fastest
            below = within[:, i] ** 2
            above = (1 - within[:, i]) ** 2
            step = np.stack([below, np.zeros(len(places)), above], axis=1)
            out = (out[:, :, None] + step[:, None, :]).reshape(len(places), -1)
        return out

    def codes(self, cells: np.ndarray, table: int) -> np.ndarray:
        """A 64-bit name of buckets; two buckets that share one are visited together."""
        code = np.full(cells.shape[:-1], table + 1, np.uint64)
        for i in range(cells.shape[-1]):
            code = mix(code ^ (cells[..., i].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return code.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(row, table): the bucket of every row."""
        cells = [np.floor(self.places(x, t)).astype(np.int64) for t in range(len(self.axes))]
        return np.stack([self.codes(c, t) for t, c in enumerate(cells)], axis=1)

    def visits(self, x: np.ndarray, table: int) -> np.ndarray:
        """(query, probe): the buckets of one table in the order of their estimated success."""
        places = self.places(x, table, query=True)
        first = np.argsort(self.costs(places), axis=1, kind="stable")[:, : self.probes]
        cells = np.floor(places).astype(np.int64)[:, None, :] + self.moves()[first]
        return self.codes(cells, table)

    def ranks(self, queries: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """For pairs (queries[of[k]], rows[k]): at which probe some table reaches the row; beyond
        all probes where none does."""
        m = self.axes.shape[2]
        best = np.full(len(rows), NO_ID // 2)
        for t in range(len(self.axes)):
            places = self.places(queries, t, query=True)
            order = np.argsort(self.costs(places), axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
            gap = np.floor(self.places(rows, t)).astype(np.int64) - np.floor(places).astype(np.int64)[of]
            near = (np.abs(gap) <= 1).all(axis=1)
            move = ((gap + 1) * 3 ** np.arange(m - 1, -1, -1)).sum(axis=1)
            found = rank[of[near], move[near]]
            best[near] = np.minimum(best[near], found)
        return best


class Block:
    """Rows that are searched together; equal vectors are one, with their ids in order."""

    def __init__(self, ids, prints, x, buckets):
        x = x + 0.0  # no negative zeros
        order = np.lexsort((ids, prints))
        ids, prints, x, buckets = ids[order], prints[order], x[order], buckets[order]
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x[1:] != x[:-1]).any(axis=1)
        self.starts = np.flatnonzero(fresh)
        self.ends = np.append(self.starts[1:], len(x))
        self.ids, self.prints, self.x = ids, prints[fresh], x[fresh]
        self.names, self.local = np.unique(buckets[fresh], return_inverse=True)

    def near(self, queries: np.ndarray, allowed: np.ndarray | None, k: int):
        """(query, vector) pairs that hold every row among a query's k best: k + 1 vectors, as one
        may be the query's own, and all that come within rounding of the last of them."""
        score = queries @ self.x.T
        if allowed is not None:
            score[~allowed[:, self.local]] = -np.inf
        last = max(0, score.shape[1] - k - 1)
        floor = np.partition(score, last, axis=1)[:, last]
        slack = 1e-12 * np.sqrt((queries**2).sum(axis=1) * (self.x**2).sum(axis=1).max())
        return np.nonzero((score >= (floor - slack)[:, None]) & (score > -np.inf))


class Best:
    """The k best rows of each query so far."""

    def __init__(self, k: int):
        self.k = k
        self.clear()

    def clear(self):
        self.slots: dict = {}
        shape = (0, self.k)
        self.score = np.zeros(shape)
        self.id, self.print = np.zeros(shape, np.int64), np.zeros(shape, np.int64)

    def slot(self, keys) -> np.ndarray:
        at = np.array([self.slots.setdefault(key, len(self.slots)) for key in keys])
        if len(self.slots) > len(self.score):
            more = (max(len(self.slots), 2 * len(self.score)) - len(self.score), self.k)
            self.score = np.vstack([self.score, np.full(more, -np.inf)])
            self.id = np.vstack([self.id, np.zeros(more, np.int64)])
            self.print = np.vstack([self.print, np.zeros(more, np.int64)])
        return at

    def search(self, block: Block, ids, prints, x, allowed=None):
        """Takes in the best rows of a block for distinct queries."""
        k = self.k
        query, vector = block.near(x, allowed, k)
        if not len(query):
            self.slot(zip(ids.tolist(), prints.tolist(), strict=True))
            return
        # Always the same order of summation, so equal vectors have equal scores everywhere.
        score = (x[query] * block.x[vector]).sum(axis=1)
        # Of the ids of a vector, k and perhaps the query's own can matter.
        many = np.minimum(block.ends[vector] - block.starts[vector], k + 1)
        pair = np.repeat(np.arange(len(query)), many)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        found = block.ids[block.starts[vector[pair]] + nth]
        mark = block.prints[vector[pair]]
        own = (found == ids[query[pair]]) & (mark == prints[query[pair]])
        pair, found, mark = pair[~own], found[~own], mark[~own]
        at = self.slot(zip(ids.tolist(), prints.tolist(), strict=True))
        local = np.arange(len(x))
        who = np.concatenate([query[pair], np.repeat(local, k)])
        score = np.concatenate([score[pair], self.score[at].reshape(-1)])
        found = np.concatenate([found, self.id[at].reshape(-1)])
        mark = np.concatenate([mark, self.print[at].reshape(-1)])
        order = np.lexsort((mark, found, -score, who))
        who, score, found, mark = who[order], score[order], found[order], mark[order]
        same = np.zeros(len(who), bool)  # one row that several tables found
        same[1:] = (
            (who[1:] == who[:-1]) & (found[1:] == found[:-1]) & (mark[1:] == mark[:-1])
            & (score[1:] == score[:-1]) & (score[1:] > -np.inf)
        )
        who, score, found, mark = who[~same], score[~same], found[~same], mark[~same]
        first = np.searchsorted(who, local)
        nth = np.arange(len(who)) - first[who]
        stay = nth < k
        row, col = at[who[stay]], nth[stay]
        self.score[row, col], self.id[row, col], self.print[row, col] = score[stay], found[stay], mark[stay]

    def record(self) -> pa.RecordBatch | None:
        slot, rank = np.nonzero(self.score[: len(self.slots)] > -np.inf)
        if not len(slot):
            return None
        keys = np.array(list(self.slots), dtype=np.int64)
        found = self.id[slot, rank]
        return pa.record_batch(
            {
                "query_id": keys[slot, 0],
                "query_print": keys[slot, 1],
                "vec_id": pa.array(found, mask=found == NO_ID),
                "print": self.print[slot, rank],
                "score": self.score[slot, rank],
            }
        )


FOUND = "query_id long, query_print long, vec_id long, print long, score double"


def _columns(batch: pa.RecordBatch):
    ids = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return ids, batch.column("print").to_numpy(zero_copy_only=False), matrix(batch.column("vector"))


def usable(df: DataFrame) -> DataFrame:
    """vec_id, vector and print of the rows that take part, repeated rows once."""
    return (
        finite(df)
        .where(F.exists("vector", lambda c: c != 0))
        .select("vec_id", F.transform("vector", lambda c: c + F.lit(0.0)).alias("vector"))
        .distinct()
        .withColumn("print", F.xxhash64("vector"))
    )


def _sample(rows: DataFrame, n: int, most: int):
    """At most `most` rows, chosen by a hash of id and vector."""
    share = min(1.0, 1.2 * most / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("print", "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return chosen.limit(most).collect()


def best_by_query(found: DataFrame, k: int) -> DataFrame:
    """The k best of the rows that tasks found, with their rank."""
    order = Window.partitionBy("query_id", "query_print").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), "print"
    )
    ranked = found.dropDuplicates(["query_id", "query_print", "vec_id", "print"])
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(rows: DataFrame, ids, prints, x, k: int) -> DataFrame:
    """The true k best rows of a bounded set of queries, with their vectors."""

    def scan(batches):
        best = Best(k)
        for batch in batches:
            rid, mark, data = _columns(batch)
            for first in range(0, len(data), BLOCK):
                cut = slice(first, first + BLOCK)
                block = Block(rid[cut], mark[cut], data[cut], np.zeros(len(data[cut]), np.int64))
                best.search(block, ids, prints, x)
        if (out := best.record()) is not None:
            yield out

    return best_by_query(in_python(rows, scan, FOUND), k)


def fit(rows: DataFrame, queries: DataFrame, k: int) -> Index | None:
    """Cell widths from at most SAMPLE_ROWS rows, functions and probes from the true neighbours of
    at most SAMPLE_QUERIES queries: as many functions as buckets of BUCKET rows need, fewer while
    the perturbed buckets miss more than 1 - TARGET of those neighbours. Without functions the one
    bucket holds all rows and the search is exact. None without rows or queries."""
    size = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)
    n, longest = rows.agg(F.count("*"), F.max(size)).first()
    asked = _sample(queries, queries.count(), SAMPLE_QUERIES) if n else []
    if not asked:
        return None
    longest = math.sqrt(longest)
    some = np.array([r["vector"] for r in _sample(rows, n, SAMPLE_ROWS)] or [asked[0]["vector"]])
    ids = np.array([r["vec_id"] for r in asked], np.int64)
    prints = np.array([r["print"] for r in asked], np.int64)
    x = np.array([r["vector"] for r in asked])
    truth = exact(rows, ids, prints, x, k)
    truth = truth.join(rows.select("vec_id", "print", "vector"), ["vec_id", "print"]).collect()
    place = {key: i for i, key in enumerate(zip(ids.tolist(), prints.tolist(), strict=True))}
    of = np.array([place[r["query_id"], r["query_print"]] for r in truth], np.int64)
    near = np.array([r["vector"] for r in truth]).reshape(len(truth), x.shape[1])
    rng = np.random.default_rng(SEED)
    axes = rng.normal(size=(TABLES, x.shape[1] + 1, FUNCTIONS))
    offsets = rng.uniform(size=(TABLES, FUNCTIONS))
    spread = np.stack([(lifted(some, longest, False) @ a).std(axis=0) for a in axes])
    cells = CELL * np.where(spread > 0, spread, 1.0)
    m = min(FUNCTIONS, max(0, math.ceil(math.log2(max(n, 1) / BUCKET) / 1.3)))
    for functions in range(m, -1, -1):
        index = Index(longest, axes[..., :functions], offsets[:, :functions], cells[:, :functions])
        rank = np.sort(index.ranks(x, near, of))
        need = rank[max(0, math.ceil(TARGET * len(rank)) - 1)] + 1 if len(rank) else 1
        if need <= 3**functions:
            break
    return Index(longest, index.axes, index.offsets, index.cells, int(need))


def search(df: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: for each row that `is_query` (over vec_id) marks, the k
    rows found with the largest inner product, ties to the smaller vec_id (nulls last).

    Usable rows are those of vectors.finite without zero vectors. Rows equal in id and vector are
    one; rows that share a query's id but not its vector are candidates like others. Rows without
    an id are candidates only. No usable row, or no query, gives no rows; other columns are not
    read. All rows are indexed; see `fit` for what is sampled and how the recall is set.

    Each table deals the rows into blocks of whole buckets, about BLOCK rows each; a bucket beyond
    that is spread over several blocks. A query goes once to each block in which it has probes,
    with the list of its buckets there. A task holds one block, streams its queries through it
    and keeps the k best of at most HELD queries; candidate pairs never become rows. Queries that
    find fewer than k rows this way (or all others, if there are not that many) are then searched
    exactly, block by block.
    """
    rows = stored(usable(df), "vectors")
    queries = rows.where(is_query & F.col("vec_id").isNotNull())
    index = fit(rows, queries, k)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return df.sparkSession.createDataFrame([], schema)
    n = rows.count()
    groups = max(1, math.ceil(n / BLOCK))

    def hashed(batches):
        for batch in batches:
            x = matrix(batch.column("vector"))
            columns = [batch.column(c) for c in ("vec_id", "print", "vector")]
            names = ["vec_id", "print", "vector", "buckets"]
            yield pa.record_batch([*columns, lists(index.buckets(x))], names=names)

    def probing(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                part = batch.slice(first, STEP)
                x = matrix(part.column("vector"))
                for table in range(TABLES):
                    codes = index.visits(x, table)
                    group = codes % groups
                    who = np.repeat(np.arange(len(x)), codes.shape[1])
                    codes, group = codes.reshape(-1), group.reshape(-1)
                    order = np.lexsort((codes, group, who))
                    who, codes, group = who[order], codes[order], group[order]
                    new = np.ones(len(who), bool)
                    new[1:] = (who[1:] != who[:-1]) | (group[1:] != group[:-1])
                    at = np.flatnonzero(new)
                    offsets = np.append(at, len(who)).astype(np.int32)
                    take = pa.array(who[at])
                    yield pa.record_batch(
                        {
                            "table": pa.array(np.full(len(at), table), pa.int32()),
                            "group": group[at],
                            "vec_id": part.column("vec_id").take(take),
                            "print": part.column("print").take(take),
                            "vector": part.column("vector").take(take),
                            "buckets": pa.ListArray.from_arrays(offsets, pa.array(codes)),
                        }
                    )

    where = "table int, group long, "
    row = "vec_id long, print long, vector array<double>, buckets array<long>"
    dealt = in_python(rows, hashed, row).select(
        "vec_id", "print", "vector", F.posexplode("buckets").alias("table", "bucket")
    )
    dealt = dealt.withColumn("group", F.pmod("bucket", F.lit(groups)))
    crowded = stored(
        dealt.groupBy("table", "group", "bucket")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > BLOCK)
        .select("table", "group", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")),
        "crowded-buckets",
    )
    held = crowded.count()
    spread = F.pmod(F.xxhash64("vec_id", "print"), F.coalesce("parts", F.lit(1)))
    data = (
        dealt.join(broadcast_within(crowded, held, CROWDED), ["table", "group", "bucket"], "left")
        .withColumn("part", spread.cast("int"))
        .select("table", "group", "part", F.lit(0).alias("kind"), "vec_id", "print", "vector",
                F.array("bucket").alias("buckets"))
    )
    parts = crowded.groupBy("table", "group").agg(F.max("parts").alias("parts"))

    def best_of(asked):
        """Queries (table, group and their buckets there) against the blocks they name."""
        asked = asked.join(broadcast_within(parts, held, CROWDED), ["table", "group"], "left")
        asked = asked.withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        )
        asked = asked.select(
            "table", "group", "part", F.lit(1).alias("kind"), "vec_id", "print", "vector", "buckets"
        )
        key = ["table", "group", "part"]
        streams = data.union(asked).repartition(*key).sortWithinPartitions(*key, "kind")
        found = in_python(streams, lambda batches: _blocks(batches, k), FOUND)
        return stored(best_by_query(found, k), "neighbours")

    found = best_of(in_python(queries, probing, where + row))
    # Queries whose buckets hold fewer rows than they may have go through all blocks of a table.
    query_key = [F.col("vec_id").alias("query_id"), F.col("print").alias("query_print")]
    enough = found.where(F.col("rank") == min(k, n - 1)).select("query_id", "query_print")
    short = stored(
        queries.select("vec_id", "print", "vector", *query_key).join(
            enough.hint("merge"), ["query_id", "query_print"], "left_anti"
        ),
        "short-queries",
    )
    if n > 1 and short.count():
        everywhere = short.select(
            F.lit(0).alias("table"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
            "vec_id",
            "print",
            "vector",
            F.array().cast("array<long>").alias("buckets"),
        )
        again = short.select("query_id", "query_print").hint("merge")
        found = found.join(again, ["query_id", "query_print"], "left_anti").unionByName(
            best_of(everywhere)
        )
    return found.select("query_id", "rank", "vec_id", "score")


def _blocks(batches, k: int):
    """Rows of a block come first, then its queries; blocks follow one another."""
    best, current, gathered, block = Best(k), None, [], None
    for batch in batches:
        key = np.stack(
            [batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "group", "part", "kind")],
            axis=1,
        )
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for first, last in itertools.pairwise([0, *cuts.tolist(), len(key)]):
            if first == last:
                continue
            name, kind = tuple(key[first, :3]), key[first, 3]
            if name != current:
                current, gathered, block = name, [], None
            run = batch.slice(first, last - first)
            if kind == 0:
                gathered.append((*_columns(run), run.column("buckets").flatten().to_numpy()))
                continue
            if not gathered:
                continue
            if block is None:
                block = Block(*(np.concatenate(c) for c in zip(*gathered, strict=True)))
            for at in range(0, run.num_rows, STEP):
                part = run.slice(at, STEP)
                ids, prints, x = _columns(part)
                probes = part.column("buckets")
                many = probes.value_lengths().to_numpy()
                who = np.repeat(np.arange(len(x)), many)
                codes = probes.flatten().to_numpy()
                place = np.searchsorted(block.names, codes)
                place[place == len(block.names)] = 0
                hit = block.names[place] == codes
                allowed = np.zeros((len(x), len(block.names)), bool)
                allowed[many == 0] = True  # without a list of buckets: all of them
                allowed[who[hit], place[hit]] = True
                best.search(block, ids, prints, x, allowed)
            if len(best.slots) >= HELD:
                if (out := best.record()) is not None:
                    yield out
                best.clear()
    if (out := best.record()) is not None:
        yield out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


SQL = None
