import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscale.config import Precision, Weights
from rollscale.functions import ball, kernels, probit, trend
from rollscale.functions import votes as V
from rollscale.functions.spatial import GRAD_SCALE


def exact_log_phi(z):
    return math.log(0.5 * math.erfc(-z / math.sqrt(2.0)))


def test_log_phi_matches_the_error_function(spark):
    z = [x / 8.0 for x in range(-40, 41)]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    df = probit.with_log_phi(df, "z").withColumns(
        {
            "one": probit.log_phi(F.col("z")),
            "grid": probit.log_phi_linear(F.col("z")),
            "near": probit.log_phi_nearest(F.col("z")),
        }
    )
    for r in df.collect():
        want = exact_log_phi(r["z"])
        assert r["ll"] == pytest.approx(want, abs=1e-9)
        assert r["one"] == pytest.approx(want, abs=1e-9)
        assert r["grid"] == pytest.approx(want, abs=1e-8)
        # The legacy lookup stops two grid steps before the end of its table.
        assert r["near"] == pytest.approx(want, abs=2e-3)


def test_log_phi_is_flat_beyond_the_clamp(spark):
    df = spark.createDataFrame([(-9.0,), (-5.0,), (5.0,), (9.0,)], "z double")
    a, b, c, d = [r["ll"] for r in probit.with_log_phi(df, "z").collect()]
    assert a == b and c == d


def test_numpy_table_is_the_grid_interpolation():
    z = np.linspace(-6, 6, 5001)
    want = np.array([exact_log_phi(min(5.0, max(-5.0, v))) for v in z])
    assert np.abs(probit.log_phi_np(z) - want).max() < 2e-9


def test_vote_codes(spark):
    codes = [-1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None]
    df = spark.createDataFrame([(c,) for c in codes], "code int")
    got = [r["v"] for r in df.select(V.vote_of(F.col("code")).alias("v")).collect()]
    assert got == [None, None, True, True, True, False, False, False, None, None, None, None]


def test_free_form_cells(spark):
    cells = [" 1 ", "6", "6.5", "0", "x", None, "3.2", "NaN"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r["v"] for r in df.select(V.is_observed_cell(F.col("c")).alias("v")).collect()]
    assert got == [True, True, False, False, False, False, True, False]


def test_start_rounding_keeps_nan_and_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.0625,), (0.1875,), (float("nan"),), (-0.0005,)], "x double")
    got = [r["y"] for r in df.select(V.round_start(F.col("x")).alias("y")).collect()]
    assert got[0] == 0.062 and got[1] == 0.188 and math.isnan(got[2]) and abs(got[3]) == 0.0


def test_ball_contract_keeps_snaps_and_rejects(spark):
    df = spark.createDataFrame(
        [(0.3, 0.4), (1.0 + 1e-10, 0.0), (1.2, 0.0), (float("nan"), 0.0)], "x double, y double"
    )
    rows = df.select(
        *[c.alias(n) for n, c in ball.ball_contract(F.col("x"), F.col("y"), 1e-8).items()]
    ).collect()
    assert rows[0]["feasible"] and rows[0]["accepted1"] == 0.3 and not rows[0]["corrected"]
    assert rows[1]["feasible"] and rows[1]["corrected"] and rows[1]["accepted1"] == 1.0
    assert not rows[2]["feasible"] and rows[2]["accepted1"] is None
    assert not rows[3]["feasible"] and rows[3]["violation"] == float("inf")


def test_bound_contract_needs_ordered_bounds():
    with pytest.raises(ValueError):
        ball.bound_contract(F.lit(1.0), 2.0, 1.0, 0.0)


def test_local_time_and_order(spark):
    df = spark.createDataFrame([(k, 5) for k in range(1, 6)] + [(1, 1)], "k int, n int")
    t = [r["t"] for r in df.select(trend.local_time(F.col("k"), F.col("n")).alias("t")).collect()]
    assert t == [-1.0, -0.5, 0.0, 0.5, 1.0, -1.0]
    tenure = spark.createDataFrame([(k,) for k in (1, 4, 5, 6, 7, 9)], "n int")
    order = [
        r["o"] for r in tenure.select(trend.effective_order(F.col("n"), 3).alias("o")).collect()
    ]
    assert order == [0, 0, 1, 2, 3, 3]


def test_precision_schedule():
    p = Precision.profile("standard")
    assert p.for_cycle(4, 1, 4, True) == p
    assert p.for_cycle(1, 1, 4, True).item_evals == 100
    with pytest.raises(ValueError):
        Precision.profile("none")


def _numeric(rows, theta, i, h=2e-5):
    up, down = theta.copy(), theta.copy()
    up[:, i] += h
    down[:, i] -= h
    active = np.ones(len(theta), bool)
    # Exact likelihood: the grid table is piecewise linear.
    return (_exact(rows, up, active) - _exact(rows, down, active)) / (2 * h)


def _exact(rows, theta, active):
    saved = kernels.log_phi_np
    kernels.log_phi_np = lambda z: probit._exact_log_phi_np(np.clip(z, -5, 5))
    try:
        return rows.derivatives(theta, active)[0]
    finally:
        kernels.log_phi_np = saved


def test_gradients_match_central_differences():
    rng = np.random.default_rng(3)
    w = Weights(w2=0.6, beta=4.0)
    number = np.repeat(np.arange(3), 40)
    x = rng.uniform(-0.7, 0.7, (120, 2))
    vote = rng.random(120) < 0.5
    theta = rng.uniform(-0.3, 0.3, (3, 4)) + [0, 0, 0.3, 0.3]
    items = kernels.ItemRows(number, x, vote, 3, w)
    gradient = GRAD_SCALE * w.beta * items.derivatives(theta, np.ones(3, bool))[1]
    for i in range(4):
        assert np.allclose(gradient[:, i], _numeric(items, theta, i), rtol=3e-3, atol=1e-4)
    t = rng.uniform(-1, 1, 120)
    basis = np.stack([np.ones(120), t, (3 * t * t - 1) / 2, (5 * t**3 - 3 * t) / 2], axis=1)
    actors = kernels.ActorRows(
        number, basis, rng.uniform(-0.4, 0.4, (120, 2)), rng.uniform(0.1, 0.4, (120, 2)), vote, 3, w
    )
    coefs = rng.uniform(-0.2, 0.2, (3, 8))
    gradient = GRAD_SCALE * w.beta * actors.derivatives(coefs, np.ones(3, bool))[1]
    for i in range(8):
        assert np.allclose(gradient[:, i], _numeric(actors, coefs, i), rtol=3e-3, atol=1e-4)


def test_candidates_agree_with_derivatives():
    rng = np.random.default_rng(5)
    w = Weights()
    number = np.repeat(np.arange(2), 30)
    items = kernels.ItemRows(number, rng.normal(0, 0.4, (60, 2)), rng.random(60) < 0.5, 2, w)
    thetas = rng.normal(0, 0.3, (4, 2, 4))
    valid = np.array([[1, 1], [1, 0], [1, 1], [0, 1]], bool)
    found = items.candidates(thetas, valid)
    for c in range(4):
        ll = items.derivatives(thetas[c], np.ones(2, bool))[0]
        assert np.allclose(found[c][valid[c]], ll[valid[c]])
        assert np.isinf(found[c][~valid[c]]).all()


def test_bound_rule_equals_the_columns(spark):
    values = [-2.0, -0.55, -0.5500001, -0.5, 0.0, 0.5, 0.52, 0.6, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", *[c.alias(n) for n, c in ball.bound_contract(F.col("x"), -0.5, 0.5, 0.05).items()])
    for value, row in zip(values, rows.collect(), strict=True):
        rule = ball.bound_rule(value, -0.5, 0.5, 0.05)
        assert {n: row[n] for n in rule} == rule
    with pytest.raises(ValueError, match="bounds"):
        ball.bound_rule(0.0, 2.0, 1.0, 0.0)
