"""The prefix trie against a dictionary of sequences."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from rollscale.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, key string, n_convs int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    nodes = collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, len(path) == d))
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (
            min(c for c, _ in members),
            len(k),
            min(c for c, _ in nodes[k[:-1]]) if k else -1,
            len(members),
            children[k],
            leaves[k],
            saved[k],
            hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in members if e)).encode()).hexdigest(),
        )
        for k, members in nodes.items()
    )


def result(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(10 * n), n):
        hot = rng.random() < 0.4
        for t in range(rng.choice([0, 1, 3, 12, 40]) + 1):
            rows.append((c, t, "user", f"h{t}" if hot or t < 2 else rng.choice(["a", "ä😀", None, "bb"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [60, 700, prefixes.SHARD_TURNS])
def test_trie_equals_a_dictionary(spark, shard_turns):
    rows = conversations(5, 120)
    assert result(prefixes.build(table(spark, rows), shard_turns)) == brute(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (5, None, "user", "first"),
        (5, 3, None, None),
        (5, 1, "assistant", ""),
        (6, 1, "assistant", ""),
        (6, 1, "assistant", ""),
        (None, 1, "user", "lost"),
        (7, 0, "1", ":x"),
        (8, 0, "", "1::x"),
        (10, 0, "user", "long " * 50_000),
        (11, 0, "user", "long " * 50_000),
        (9_000_000_000, 0, "user", "first"),
    ]
    assert result(prefixes.build(table(spark, rows))) == brute(rows)
    assert prefixes.build(table(spark, rows).where("false")).collect() == []


def test_rows_sort_like_tuples():
    rng = np.random.default_rng(2)
    paths = [tuple(rng.integers(0, 2, rng.integers(0, 70)).tolist()) for _ in range(300)]
    paths += [(1,) * n for n in (0, 31, 32, 33, 64, 65)] * 2
    lengths = np.array([len(p) for p in paths])
    conv = rng.permutation(len(paths))
    turns = np.array([t for p in paths for t in p])
    order = prefixes.sorted_rows(turns, np.cumsum(lengths) - lengths, lengths, conv)
    assert order.tolist() == sorted(range(len(paths)), key=lambda i: (paths[i], conv[i]))


def test_trie_equals_its_sql(spark):
    directory = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS FROM '{directory}/conversations.parquet'")
    want = sorted(tuple(-1 if v is None else v for v in r) for r in db.execute(prefixes.SQL).fetchall())
    assert result(prefixes.query(spark, directory)) == want
