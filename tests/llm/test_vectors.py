"""Operators on embeddings against numpy and plain integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscale.llm import neighbours, vectors, whitening

ROWS = "vec_id long, embedding array<double>, x string, n long"


def clashing(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, "a", 7) for i, v in rows], ROWS)


@pytest.mark.parametrize("low,high", [(-300, 300), (0, 1), (5, 6), (-(2**40), 2**40), (-(2**62), 2**62)])
def test_bit_planes_give_exact_products(low, high):
    x = np.random.default_rng(3).integers(low, high, (205, 5))
    wide = x.astype(object)
    sums, products = whitening.cross_products(x)
    assert sums == wide.sum(axis=0).tolist()
    assert products == (wide.T @ wide).tolist()
    for row, column in ((0, 1), (2, 2)):
        value = products[row][column]
        low_part, middle, high_part = whitening.limbs(value)
        assert low_part + (middle << 60) + (high_part << 120) == value


def test_whitening_equals_numpy(spark):
    df = vectors.embeddings(spark, "/root/testdata/sf0.001")
    got = whitening.query(spark, "/root/testdata/sf0.001").orderBy("vec_id", "component").toPandas()
    raw = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=float)
    x = np.floor(256 * raw).astype(int)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    want = (x - sums / n) @ axes / np.sqrt(values)
    whitened = got.whitened.to_numpy().reshape(-1, 4)
    signs = np.sign((whitened * want).sum(axis=0))
    assert np.abs(whitened * signs - want).max() < 1e-9
    assert (got.n == n).all() and got.identity_error.max() < 1e-9
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert (got.deviation.to_numpy().reshape(-1, 4) == deviation[:, None]).all()
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4), values / np.trace(cov), rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    plain = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    odd = [
        (100, None),
        (101, []),
        (102, [1.0, None, 2.0]),
        (103, [float("nan"), 0.0, 0.0]),
        (104, [float("inf"), 0.0, 0.0]),
        (105, [1.0, 2.0]),
        (None, plain[0][1]),
        (0, plain[0][1]),
        (106, [-0.0, 0.0, 1e-9]),
    ]
    got = whitening.whiten(clashing(spark, plain + odd)).collect()
    ids = [r.vec_id for r in got if r.component == 1]
    assert sorted(i for i in ids if i is not None) == [0, 0, *range(1, 30), 106]
    assert ids.count(None) == 1 and len(got) == 3 * 33
    assert {r.n for r in got} == {31}
    same = {tuple(r)[1:5] for r in got if r.vec_id in (0, None) and r.component == 1}
    assert len(same) == 1


def test_whitening_without_variance_or_rows(spark):
    one = whitening.whiten(clashing(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and {r.n for r in one} == {1} and {r.deviation for r in one} == {0}
    assert all(r.whitened is None and r.explained is None for r in one)
    assert all(r.identity_error is None for r in one)
    assert whitening.whiten(clashing(spark, [(1, None)])).collect() == []
    line = whitening.whiten(clashing(spark, [(i, [float(i), 0.0]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert max(r.identity_error for r in line) < 1e-12


def brute(rows, asked, k):
    """Per query (id, vector): ids of the k best and their scores."""
    rows = {(i, tuple(v)) for i, v in rows}
    out = {}
    for i, v in rows:
        if i is None or not asked(i):
            continue
        others = [(-float(np.dot(v, w)), j is None, j or 0, w) for j, w in rows if (j, w) != (i, v)]
        out[i] = [(None if none else j, -s) for s, none, j, _ in sorted(others)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    same = [3.0, 0.0, -1.0, 2.0]
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(1, 90)]
    rows = [r for r in rows if any(r[1])] + [(100 + i, same) for i in range(40)]
    rows += [(7, [9.0, 9.0, 9.0, 9.0]), (None, same), (500, [1e3, 0.0, 0.0, 0.0])]
    odd = [(400, None), (401, [0.0] * 4), (402, [1.0, None, 1.0, 1.0]), (403, [1.0]), (404, [float("inf")] * 4)]
    repeated = rows[:5] + rows[-3:]
    df = clashing(spark, rows + odd + repeated)
    rows = [r for r in rows if r[0] != 7]  # two vectors under one id: its answers share query_id
    df = df.where("vec_id IS NULL OR vec_id <> 7")
    got = found(neighbours.search(df, F.col("vec_id") % 20 == 0, 20))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and 400 not in got
    for i, near in want.items():
        assert [j for j, _ in got[i]] == [j for j, _ in near]
        assert np.allclose([s for _, s in got[i]], [s for _, s in near])
    few = found(neighbours.search(df.where("vec_id <= 3 OR vec_id = 100"), F.lit(True), 20))
    assert all(len(v) == len(few) - 1 for v in few.values())
    assert neighbours.search(df.where("false"), F.lit(True)).collect() == []
    assert neighbours.search(df, F.lit(False)).collect() == []


def test_neighbours_recall_with_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 128)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 2000)] + 0.3 * rng.normal(size=(2000, 16))
    x *= rng.uniform(0.5, 2.0, (2000, 1))
    x[:700] = x[0]  # a third of the rows are copies
    df = clashing(spark, list(enumerate(x.tolist())))
    got = found(neighbours.search(df, F.col("vec_id") % 20 == 0, 20))
    asked = np.arange(0, 2000, 20)
    score = x[asked] @ x.T
    score[np.arange(100), asked] = -np.inf
    last = np.sort(score, axis=1)[:, -20]
    hits = sum(s >= low - 1e-9 for i, low in zip(asked, last, strict=True) for _, s in got[int(i)])
    assert hits >= 0.9 * 2000
    copies = [j for j, _ in got[20] if j < 700]  # ties go to the smaller ids
    assert copies and copies == [j for j in range(700) if j != 20][: len(copies)]


def test_probes_come_in_order_of_cost():
    rng = np.random.default_rng(8)
    axes, offsets = rng.normal(size=(2, 6, 3)), rng.uniform(size=(2, 3))
    index = neighbours.Index(3.0, axes, offsets, np.full((2, 3), 2.0), 27)
    x = rng.normal(size=(9, 5))
    places = index.places(x, 1, query=True)
    within = places - np.floor(places)
    moves = index.moves()
    want = [[sum({-1: f**2, 0: 0, 1: (1 - f) ** 2}[d] for f, d in zip(w, m, strict=True)) for m in moves.tolist()] for w in within]
    assert np.allclose(index.costs(places), want)
    assert (index.visits(x, 1)[:, 0] == index.codes(np.floor(places).astype(int), 1)).all()
    near = x * (2.999 / np.linalg.norm(x, axis=1))[:, None]
    assert (index.ranks(x, near, np.arange(9)) < 27).all()


def test_queries_that_find_too_few_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 2)
    monkeypatch.setattr(neighbours, "TARGET", 0.3)
    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 8)).tolist())]
    got = found(neighbours.search(clashing(spark, rows), F.col("vec_id") % 20 == 0, 20))
    assert len(got) == 15 and all(len(v) == 20 for v in got.values())
