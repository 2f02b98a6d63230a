from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollscale.config import Limits
from rollscale.operators import audit, compare, convergence, cuts, running, screens, trajectory
from rollscale.operators.totals import with_totals

TINY = replace(Limits(), group_rows=5)


def rows_of(df, *order):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def points(spark):
    """One hot roll call with many equal projections, and small ones."""
    rng = np.random.default_rng(11)
    rows = []
    for rc, n in ((1, 400), (2, 7), (3, 1), (4, 30)):
        for m in range(n):
            proj = float(np.round(rng.normal(0, 0.5), 1))
            vote = [True, False, None][rng.integers(0, 3)]
            rows.append((rc, m + 1, proj, vote, proj, float(rng.normal())))
    schema = "rollcall_id bigint, legislator_id bigint, proj double, vote boolean, x1 double, x2 double"
    return spark.createDataFrame(rows, schema).repartition(5)


def test_blocked_running_equals_window(points):
    columns = {
        "n": running.Running(F.lit(1).cast("long"), span="upto"),
        "before": running.Running(F.coalesce(F.col("vote").cast("long"), F.lit(0).cast("long"))),
        "all": running.Running(F.lit(1).cast("long"), span="total"),
        "prev": running.Running(F.col("proj"), kind="max"),
    }
    names = ["rollcall_id", "legislator_id", *columns]
    args = (points, ["rollcall_id"], ["proj", "legislator_id"], columns)
    plain = running.running(*args).select(*names)
    split = running.running(*args, TINY).select(*names)
    assert rows_of(plain.fillna(-99.0)) == rows_of(split.fillna(-99.0))


def test_ranks_and_medians_with_ties(points):
    pdf = points.toPandas()
    want = pdf.groupby("rollcall_id")["proj"].rank(method="average")
    for limits in (Limits(), TINY):
        got = running.average_ranks(points, ["rollcall_id"], "proj", "rank", limits).toPandas()
        merged = pdf.assign(want=want).merge(got, on=["rollcall_id", "legislator_id"])
        assert np.allclose(merged["want"], merged["rank"])
        med = running.medians(points, ["rollcall_id"], "proj", "m", limits).toPandas()
        med = med.set_index("rollcall_id")["m"].sort_index()
        assert np.allclose(med, pdf.groupby("rollcall_id")["proj"].median())


def brute_cut(pdf):
    """Every candidate of one roll call, both polarities, by counting."""
    pdf = pdf.sort_values(["proj", "legislator_id"]).reset_index(drop=True)
    p, v = pdf["proj"].to_numpy(), pdf["vote"].to_numpy()
    best = None
    total = sum(x is not None for x in v)
    for order, low in ((0, True), (1, False)):
        found = []
        for i in range(len(p)):
            at = p[0] - 0.001 if i == 0 else (p[i] + p[i - 1]) / 2
            errors = sum(x is not None and x != low for x in v[:i])
            errors += sum(x is not None and x == low for x in v[i:])
            found.append((errors, at, i))
        least = min(f[0] for f in found)
        tied = [f for f in found if (f[0] - least) <= 1e-5 * max(total, 1)]
        pick = min(tied, key=lambda f: (abs(f[1]), f[2]))
        if best is None or pick[0] < best[0]:
            best = (pick[0], pick[1], "yes_low" if low else "no_low")
    return best


def test_best_cut_against_brute_force(points):
    pdf = points.toPandas()
    pdf["vote"] = [None if v is None or pd.isna(v) else bool(v) for v in pdf["vote"]]
    want = {rc: brute_cut(g) for rc, g in pdf.groupby("rollcall_id")}
    for limits in (Limits(), TINY):
        for r in cuts.best_cuts(points, limits).collect():
            errors, at, polarity = want[r["rollcall_id"]]
            assert (r["errors"], r["polarity"]) == (errors, polarity)
            assert r["cut"] == pytest.approx(at)


def test_tie_tolerance_path_agrees(points, monkeypatch):
    first = cuts.best_cuts(points).select("rollcall_id", "cut", "errors", "polarity")
    want = rows_of(first)
    monkeypatch.setattr(cuts, "TIE", 1e-3)  # 400 rows x 1e-3 stays below one error
    monkeypatch.setattr(cuts, "largest_group", lambda *a: 10_000_000)
    assert rows_of(cuts.best_cuts(points, Limits(group_rows=10**9)).select("rollcall_id", "cut", "errors", "polarity")) == want


def test_row_order_does_not_matter_and_absent_is_never_an_error(points):
    a = cuts.best_cuts(points)
    b = cuts.best_cuts(points.orderBy(F.rand(3)))
    assert rows_of(a) == rows_of(b)
    classed = cuts.classify(points, a)
    assert classed.where(F.col("vote").isNull() & (F.col("error") != -1)).count() == 0


def test_fixed_polarity(points):
    r = cuts.best_cuts(points, fixed=F.lit("no_low")).select("polarity").distinct().collect()
    assert [x[0] for x in r] == ["no_low"]


def test_starts_turn_the_normal(spark):
    df = spark.createDataFrame(
        [(1, -0.6, 0.8, 0.5, "yes_low"), (2, 1.0, 0.0, 3.0, "no_low")],
        "rollcall_id bigint, n1 double, n2 double, cut double, polarity string",
    )
    a, b = sorted(cuts.starts_from_cuts(df).collect())
    assert a["polarity"] == "no_low" and a["z1"] == pytest.approx(-0.3) and a["d1"] == pytest.approx(-0.3)
    assert b["z1"] == pytest.approx(1.0) and b["d1"] == pytest.approx(-0.5)


def test_last_row_wins(spark):
    df = spark.createDataFrame(
        [(1, "a", 1), (1, None, 3), (1, "c", 2), (2, "z", 1)], "id int, v string, o int"
    )
    assert rows_of(screens.last_wins(df, ["id"], "o").fillna("-")) == [(1, "-"), (2, "z")]


def test_alignment_recovers_rotation_and_mirror(spark):
    rng = np.random.default_rng(1)
    b = rng.normal(size=(50, 2))
    for q in (np.array([[0.8, -0.6], [0.6, 0.8]]), np.array([[0.8, 0.6], [0.6, -0.8]])):
        a = b @ q + [0.3, -0.2]
        rows = [(i, 1, *map(float, a[i]), *map(float, b[i])) for i in range(50)]
        df = spark.createDataFrame(
            rows, "legislator_id int, period int, a1 double, a2 double, b1 double, b2 double"
        )
        for by in (None, ["period"]):
            s = compare.scores(compare.align(df, by)).first()
            assert s["max_distance"] < 1e-9 and s["r1"] == pytest.approx(1.0)


def test_paths_recover_polynomials(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for m, k in ((1, 1), (2, 4), (3, 5), (4, 6), (5, 7), (6, 9)):
        order = 3 if k >= 7 else 2 if k == 6 else 1 if k == 5 else 0
        beta = rng.normal(size=(4, 2)) * (np.arange(4)[:, None] <= order)
        want[m] = beta
        for i in range(k):
            t = -1 + 2 * i / (k - 1) if k > 1 else -1.0
            basis = np.array([1, t, (3 * t * t - 1) / 2, (5 * t**3 - 3 * t) / 2])
            x = basis @ beta
            rows.append((m, 2 * i + 1, float(x[0]), float(x[1])))
    df = spark.createDataFrame(rows, "legislator_id int, period int, x1 double, x2 double")
    paths = trajectory.least_squares_paths(df)
    for r in paths.collect():
        got = np.array([[r[f"b{j}_{k}"] for k in (1, 2)] for j in range(4)])
        assert np.allclose(got, want[r["legislator_id"]], atol=1e-9)
    check = trajectory.centre_audit(df, paths).first()
    assert check["max_reconstruction_error"] < 1e-9 and check["max_identity_error"] < 1e-9
    kept = trajectory.least_squares_paths(df, grid=trajectory.served_grid(df.select("legislator_id", "period")))
    assert rows_of(kept.select("legislator_id", "eff_order")) == rows_of(paths.select("legislator_id", "eff_order"))


def test_patience_and_segments(spark):
    ll = [-100.0, -50.0, -49.5, -49.4, -60.0, -59.9, -59.8]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(ll)], "iteration int, log_likelihood double")
    got = [r["streak"] for r in convergence.patience(df, 1.0).orderBy("iteration").collect()]
    assert got == [0, 0, 1, 2, 0, 1, 2]


def test_snapshots_compare_only_equal_key_sets(spark):
    rows = [(i, k, float(i)) for i in (1, 2, 3) for k in (1, 2, 3) if not (i == 3 and k == 3)]
    df = spark.createDataFrame(rows, "iteration int, k int, x double")
    got = convergence.snapshot_changes(df, ["k"], ["x"]).orderBy("iteration").collect()
    assert [r["change_l2"] is None for r in got] == [True, False, True]
    assert got[1]["change_l2"] == pytest.approx(3**0.5)


def test_trace_contract(spark):
    good = (1, 1, 1, 1e-8, 0.0, 0.5, 0, 0.0, 0)
    names = (
        "attempted int, accepted int, raw_return_feasible int, constraint_tolerance double, "
        "raw_constraint_violation double, improvement double, infeasible_objective_evaluations int, "
        "max_objective_constraint_violation double, numerical_correction_applied int"
    )
    ok = audit.check_trace(spark.createDataFrame([good, (0, 0, 1, 1e-8, 0.0, 0.0, 0, 0.0, 0)], names))
    assert ok["attempted_blocks"] == 1 and ok["skipped_blocks"] == 1
    with pytest.raises(ValueError, match="infeasible"):
        audit.check_trace(spark.createDataFrame([(1, 1, 0, 1e-8, 0.1, 0.5, 0, 0.0, 0)], names))
    with pytest.raises(ValueError, match="decreased"):
        audit.check_trace(spark.createDataFrame([(1, 1, 1, 1e-8, 0.0, -0.5, 0, 0.0, 0)], names))
    with pytest.raises(ValueError, match="missing columns"):
        audit.check_trace(spark.createDataFrame([(1,)], "attempted int"))


def test_totals_need_one_row(spark):
    two = spark.range(2).withColumnRenamed("id", "n")
    with pytest.raises(Exception):
        with_totals(spark.range(3), two).collect()
