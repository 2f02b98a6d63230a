"""Oversized groups: kernels over spread votes against the same kernels in one block."""

import numpy as np
import pandas as pd
import pytest

from rollscale.config import Precision, FitConfig, Weights
from rollscale.functions.kernels import ActorRows, ItemRows, path_basis
from rollscale.plans import planes, solvers
from rollscale.plans.spread import SpreadActorRows, SpreadCutRows, SpreadItemRows

W = Weights(w2=0.4, beta=5.0)


def cloud(seed, groups, size, digits=None, unanimous=False):
    """Members, positions and codes of some roll calls; few digits make ties."""
    rng = np.random.default_rng(seed)
    number = np.repeat(np.arange(groups), size)
    x = rng.uniform(-0.7, 0.7, (groups * size, 2))
    if digits is not None:
        x = x.round(digits)
    lean = x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.3, len(x))
    code = np.where(rng.random(len(x)) < 0.15, -1, (lean > 0.1 * number - 0.1).astype(int))
    if unanimous:
        code = np.where(number == 0, 1, np.where(number == 1, -1, code))
    member = np.tile(rng.permutation(size), groups)
    return number, member, x, code


def table(spark, number, member, x, code):
    rows = zip((10 + number).tolist(), member.tolist(), code.tolist(), *x.T.tolist(), strict=True)
    schema = "rollcall_id bigint, legislator_id bigint, code int, x1 double, x2 double"
    return spark.createDataFrame(list(rows), schema).repartition(5)


@pytest.mark.parametrize("digits,unanimous", [(None, False), (1, False), (0, True)])
@pytest.mark.parametrize("leaf_rows", [2, 4096])
def test_counted_cuts_equal_sorted_ones(spark, digits, unanimous, leaf_rows):
    number, member, x, code = cloud(11, 3, 300, digits, unanimous)
    local = planes.LocalCutRows(number, member, x, code, 3)
    spread = SpreadCutRows(table(spark, number, member, x, code), [10, 11, 12], leaf_rows)
    for angle in (0.0, 1.1):
        normals = np.tile([np.cos(angle), np.sin(angle)], (3, 1))
        active = np.array([True, True, angle == 0.0])
        want, got = local.cut(normals, active), spread.cut(normals, active)
        for name, values in want.items():
            if name in "abc":
                assert np.allclose(got[name], values, rtol=1e-12, atol=1e-14), name
            else:
                assert (np.asarray(got[name]) == np.asarray(values)).all(), name


def test_ties_within_the_tolerance(spark):
    """So many votes that cuts with one error more still tie with the best."""
    rng = np.random.default_rng(12)
    size = 120_000
    x = np.stack([rng.uniform(-0.9, 0.9, size), np.zeros(size)], axis=1)
    code = (x[:, 0] > 0.2).astype(int) ^ (rng.random(size) < 0.3)
    number, member = np.zeros(size, int), np.arange(size)
    normals, active = np.array([[1.0, 0.0]]), np.array([True])
    want = planes.LocalCutRows(number, member, x, code, 1).cut(normals, active)
    pdf = pd.DataFrame({"rollcall_id": 10 + number, "legislator_id": member, "code": code, "x1": x[:, 0], "x2": x[:, 1]})
    rows = spark.createDataFrame(pdf).selectExpr("rollcall_id", "legislator_id", "cast(code as int) code", "x1", "x2")
    got = SpreadCutRows(rows, [10]).cut(normals, active)
    for name in ("cut", "errors", "yes_low", "correct_low", "error_high"):
        assert got[name][0] == want[name][0], name


def item_rows(spark, groups, size=40):
    number, _, x, code = cloud(5, groups, size)
    vote = code == 1
    rows = zip((10 + number).tolist(), vote.tolist(), *x.T.tolist(), strict=True)
    df = spark.createDataFrame(list(rows), "rollcall_id bigint, vote boolean, x1 double, x2 double")
    keys, counts = list(range(10, 10 + groups)), [size] * groups
    spread = SpreadItemRows(df.repartition(4).persist(), "rollcall_id", keys, counts, W)
    return ItemRows(number, x, vote, groups, W), spread


def actor_rows(spark, groups, size=40):
    rng = np.random.default_rng(6)
    number = np.repeat(np.arange(groups), size)
    z, d = rng.uniform(-0.5, 0.5, (len(number), 2)), rng.uniform(0.1, 0.4, (len(number), 2))
    t, vote = rng.choice([-1.0, 0.0, 1.0], len(number)), rng.random(len(number)) < 0.5
    rows = zip((10 + number).tolist(), vote.tolist(), t.tolist(), *z.T.tolist(), *d.T.tolist(), strict=True)
    schema = "legislator_id bigint, vote boolean, t double, z1 double, z2 double, d1 double, d2 double"
    df = spark.createDataFrame(list(rows), schema).repartition(4).persist()
    keys, counts = list(range(10, 10 + groups)), [size] * groups
    return (
        ActorRows(number, path_basis(t), z, d, vote, groups, W),
        SpreadActorRows(df, "legislator_id", keys, counts, W),
    )


def agree(a, b):
    for x, y in zip(a, b, strict=True):
        assert np.allclose(x, y, rtol=1e-12, atol=1e-12)


def test_sums_agree_to_the_last_digits(spark):
    rng = np.random.default_rng(3)
    for make, width in ((item_rows, 4), (actor_rows, 8)):
        local, spread = make(spark, 4)
        theta = rng.uniform(-0.3, 0.3, (4, width))
        active = np.array([True, True, False, True])
        agree(local.derivatives(theta, active, True), spread.derivatives(theta, active, True))
        thetas = theta + 0.01 * np.arange(25)[:, None, None] * rng.normal(size=theta.shape)
        valid = rng.random((25, 4)) < 0.8
        valid[:, 2] = False
        agree(local.candidates(thetas, valid), spread.candidates(thetas, valid))


def test_fits_agree(spark):
    cfg = FitConfig()
    local, spread = item_rows(spark, 3)
    start = np.tile([0.0, 0.0, 0.3, 0.3], (3, 1))
    free = np.ones_like(start, dtype=bool)
    budget = Precision.profile("relaxed")
    agree(
        [solvers.fit_constrained(r, start, free, 2, W.beta, budget, 40)[0] for r in (local,)],
        [solvers.fit_constrained(r, start, free, 2, W.beta, budget, 40)[0] for r in (spread,)],
    )


def test_jobs_do_not_depend_on_the_number_of_groups(spark):
    """A step is one job for all groups, however many, and a row per group comes back."""

    def jobs(work):
        sc = spark.sparkContext
        sc.setJobGroup(f"count-{id(work)}", "jobs")
        work()
        found = len(sc.statusTracker().getJobIdsForGroup(f"count-{id(work)}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return found

    counted = []
    for groups in (2, 12):
        _, spread = item_rows(spark, groups)
        spread.rows.count()
        theta = np.tile([0.0, 0.1, 0.3, 0.2], (groups, 1))
        thetas, valid = np.repeat(theta[None], 30, axis=0), np.ones((30, groups), bool)
        counted.append(
            (jobs(lambda: spread.derivatives(theta, valid[0])), jobs(lambda: spread.candidates(thetas, valid)))
        )
    assert counted[0] == counted[1] and counted[0][0] > 0
