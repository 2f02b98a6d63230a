from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscale.config import FitConfig, Limits, Precision, Weights
from rollscale.operators import compare, trajectory
from rollscale.panel import TRUE_WEIGHTS
from rollscale.plans import blocks, loop, planes, scalars
from rollscale.plans.layout import lay_out

HOT = replace(Limits(), group_rows=3)
START = Weights(w2=0.45, beta=5.5)


def close(a, b, key, columns, tol=1e-6):
    left, right = (df.toPandas().sort_values(key).reset_index(drop=True) for df in (a, b))
    assert len(left) == len(right) > 0
    assert (left[key] == right[key]).all()
    for c in columns:
        assert np.allclose(left[c], right[c], atol=tol), c


@pytest.fixture(scope="module")
def small(spark):
    """Five roll calls, twelve members in two periods; absences included."""
    rng = np.random.default_rng(7)
    rows, state, bills = [], [], []
    for m in range(12):
        x = rng.uniform(-0.8, 0.8, 2)
        for p in (1, 2):
            state.append((m + 1, p, float(x[0]), float(x[1])))
    for rc in range(5):
        period = 1 + rc % 2
        bills.append((rc, period, 0.0, 0.0, 0.3, 0.3, True))
        for m in range(12):
            s = rng.random()
            vote = None if s < 0.1 else bool(state[2 * m][2] + rng.normal(0, 0.3) < 0.1 * rc - 0.2)
            rows.append((m + 1, period, rc, vote))
    return (
        spark.createDataFrame(rows, "legislator_id bigint, period int, rollcall_id bigint, vote boolean"),
        spark.createDataFrame(state, "legislator_id bigint, period int, x1 double, x2 double"),
        spark.createDataFrame(
            bills, "rollcall_id bigint, period int, z1 double, z2 double, d1 double, d2 double, valid boolean"
        ),
    )


def test_oversized_roll_calls_get_the_same_plane(small):
    votes, state, _ = small
    names = ["n1", "n2", "cut", "errors", "first_errors", "classified", "turn"]
    close(
        planes.cutting_planes(votes, state, turns=6),
        planes.cutting_planes(votes, state, HOT, turns=6),
        "rollcall_id",
        names,
    )


def test_planes_do_not_depend_on_row_order(small):
    votes, state, _ = small
    close(
        planes.cutting_planes(votes, state),
        planes.cutting_planes(votes.orderBy(F.rand(5)), state.orderBy(F.rand(6))),
        "rollcall_id",
        ["n1", "n2", "cut", "errors"],
    )


def brute_plane(pdf, turns=25):
    """One roll call turned and re-cut member by member, eigenvectors from numpy."""
    pdf = pdf.sort_values("legislator_id")
    x = pdf[["x1", "x2"]].to_numpy()
    vote = [None if v is None or v != v else bool(v) for v in pdf["vote"]]
    normal, best = np.array([1.0, 0.0]), None
    for turn in range(turns):
        proj = x @ normal
        order = sorted(range(len(x)), key=lambda i: (proj[i], i))
        options = []
        for polarity, low in ((0, True), (1, False)):
            found = []
            for j, i in enumerate(order):
                cut = proj[i] - 0.001 if j == 0 else (proj[i] + proj[order[j - 1]]) / 2
                errors = sum(vote[k] is not None and vote[k] != low for k in order[:j])
                errors += sum(vote[k] is not None and vote[k] == low for k in order[j:])
                found.append((errors, abs(cut), j, cut, low))
            options.append(min(found))
        errors, _, _, cut, low = options[0] if options[0][0] <= options[1][0] else options[1]
        if best is None or errors <= best[0]:
            best = (errors, turn, cut)
        if errors == 0:
            break
        cloud = []
        for i in range(len(x)):
            side = low if proj[i] < cut else not low
            wrong = vote[i] is not None and vote[i] != side
            cloud.append(x[i] if wrong else x[i] + (cut - proj[i]) * normal)
        normal = np.linalg.eigh(np.cov(np.array(cloud).T))[1][:, 0]
        if normal[0] < 0 or (normal[0] == 0 and normal[1] < 0):
            normal = -normal
    return best


def test_planes_against_brute_force(spark):
    rng = np.random.default_rng(23)
    rows, state = [], []
    x = rng.uniform(-0.8, 0.8, (25, 2))
    for m in range(25):
        state.append((m + 1, 1, float(x[m, 0]), float(x[m, 1])))
        for rc in range(6):
            n = np.array([np.cos(rc), np.sin(rc)])
            noisy = x[m] @ n + rng.normal(0, 0.25) < 0.1
            rows.append((m + 1, 1, rc, None if rng.random() < 0.15 else bool(noisy)))
    votes = spark.createDataFrame(rows, "legislator_id bigint, period int, rollcall_id bigint, vote boolean")
    at = spark.createDataFrame(state, "legislator_id bigint, period int, x1 double, x2 double")
    pdf = votes.join(at, ["legislator_id", "period"]).toPandas()
    for r in planes.cutting_planes(votes, at).collect():
        errors, turn, cut = brute_plane(pdf[pdf["rollcall_id"] == r["rollcall_id"]])
        assert (r["errors"], r["turn"]) == (errors, turn)
        assert r["cut"] == pytest.approx(cut, abs=1e-9)


@pytest.mark.parametrize("solver", ["line", "constrained"])
def test_oversized_groups_get_the_same_fit(small, solver):
    votes, state, bills = small
    valid = votes.where(F.col("vote").isNotNull())
    cfg = FitConfig(solver=solver)
    line = replace(cfg.line, outer_cycles=1, inner_steps=2)
    cfg = replace(cfg, line=line)
    budget = replace(Precision.profile("relaxed"), item_evals=30, actor_evals=30)

    def items(limits):
        c = replace(cfg, limits=limits)
        return blocks.fit_items(lay_out(valid, "rollcall_id", limits), state, bills, START, c, budget)

    def actors(limits):
        c = replace(cfg, limits=limits)
        return blocks.fit_actors(
            lay_out(valid, "legislator_id", limits),
            trajectory.served_grid(state.select("legislator_id", "period")),
            trajectory.start_paths(state, 1),
            bills,
            START,
            c,
            budget,
        )

    for fit, key, names in (
        (items, "rollcall_id", blocks.ITEM_COLUMNS),
        (actors, "legislator_id", blocks.BETA_COLUMNS + blocks.VARIANCE_COLUMNS),
    ):
        close(fit(Limits()), fit(HOT), key, [*names, "ll_before", "ll_after"], 1e-12)


@pytest.mark.parametrize("solver", ["line", "constrained"])
def test_block_fits_improve_and_stay_in_the_ball(panel, solver):
    from rollscale.queries import fits

    cfg = replace(fits.BASE, solver=solver)
    items = fits._items(panel, cfg).toPandas()
    assert (np.hypot(items["z1"], items["z2"]) <= 1 + 1e-9).all()
    slack = 1e-5 if solver == "line" else 1e-9
    gmp = np.exp(items["ll_after"] / items["votes"]) - np.exp(items["ll_before"] / items["votes"])
    assert (gmp >= -slack).all() and gmp.mean() > 0.05
    actors = fits._actors(panel, cfg).toPandas()
    assert (np.hypot(actors["b0_1"], actors["b0_2"]) <= 1 + 1e-9).all()
    assert (actors["ll_after"] >= actors["ll_before"] - 1e-3).all()
    short = actors["served"] < 5
    assert (actors.loc[short, ["b1_1", "b1_2"]] == 0).all().all()


def along(star, name, fixed, values):
    """Likelihoods of values of one scalar, the other one as in `fixed`."""
    w2s, betas = (values, [fixed.beta]) if name == "w2" else ([fixed.w2], values)
    return {r[name]: r["log_likelihood"] for r in scalars.lattice(star, fixed, w2s, betas).collect()}


def test_scalar_walk_follows_the_sequential_rule(panel):
    star = panel.star.select("vote", "x1", "x2", "z1", "z2", "d1", "d2").persist()
    w = START
    together = scalars.walk(star, START)
    for found in together:
        name = found["name"]

        def ask(v):
            return along(star, name, w, [v])[v]

        h, value = scalars.STEPS[name], getattr(w, name)
        first, up, down = ask(value), ask(value + h), ask(value - h)
        sign = 1 if up > first else -1 if down > first else 0
        if sign:
            value, best, step = value + sign * h, max(up, down), sign * h
            for _ in range(15):
                ll = ask(value + step)
                if ll < best:
                    step /= 2
                else:
                    value, best = value + step, max(best, ll)
        assert found["value"] == pytest.approx(value, abs=1e-12)
        assert found["ll_after"] >= found["ll_before"]
        assert found["scans"] <= 6
        alone = scalars.walk(star, w, (name,))[0]
        assert alone["value"] == found["value"]
        w = w.with_value(name, found["value"])


def test_calm_scalars_cost_one_scan(panel):
    """Where both starts are the best of their neighbours, one lattice answers everything."""
    star = panel.star.select("vote", "x1", "x2", "z1", "z2", "d1", "d2").persist()
    w = START
    for _ in range(8):
        for best in scalars.bounded(star, w):
            w = w.with_value(best["name"], best["value"])
    found = scalars.walk(star, w)
    assert sum(f["scans"] for f in found) == 1
    assert [f["value"] for f in found] == [w.w2, w.beta]


def test_bounded_scalars_respect_box_and_likelihood(panel):
    star = panel.star.select("vote", "x1", "x2", "z1", "z2", "d1", "d2").persist()
    for names in (("w2",), ("beta",), ("w2", "beta")):
        for scope in ("local", "global"):
            w = START
            for found in scalars.bounded(star, START, names, scope):
                name = found["name"]
                low, high = scalars.BOUNDS[name]
                if scope == "local":
                    radius = scalars.LOCAL_RADIUS[name]
                    low, high = max(low, found["initial"] - radius), min(high, found["initial"] + radius)
                assert low - 1e-12 <= found["value"] <= high + 1e-12
                assert found["ll_after"] >= found["ll_before"]
                assert found["stop"] in ("x", "f")
                # No value of a fine lattice around the answer is better.
                near = [found["value"] * (1 + i * 1e-4) for i in range(-20, 21)]
                around = along(star, name, w, [v for v in near if low <= v <= high])
                assert found["ll_after"] >= max(around.values()) - 1e-6
                w = w.with_value(name, found["value"])
        tight = replace(Precision.profile(), scalar_evals=9)
        for found in scalars.bounded(star, START, names, "local", tight):
            assert found["stop"] == "budget" and found["evaluations"] <= 9


def agreement(panel, fit):
    named = fit.state.select(
        "legislator_id", "period", F.col("x1").alias("coord1D"), F.col("x2").alias("coord2D")
    )
    return compare.scores(compare.align(compare.join_fits(named, panel.fit_a))).first()


@pytest.mark.parametrize("solver", ["line", "constrained"])
def test_fit_recovers_the_truth(panel_hundredth, solver):
    p = panel_hundredth
    cfg = FitConfig(cycles=2, order=1, solver=solver)
    fit = loop.fit(p.votes, cfg, START, p.seeds_member, p.seeds_period)
    s = agreement(p, fit)
    assert s["r1"] >= 0.95 and s["r2"] >= 0.8
    keys = fit.state.select("legislator_id", "period")
    assert keys.count() == keys.distinct().count() == p.placements.count()
    assert fit.trace[1]["log_likelihood"] > fit.trace[0]["log_likelihood"]
    # Negative control: votes that do not follow the members must not pass.
    noise = p.votes.withColumn(
        "vote", F.when(F.col("vote").isNotNull(), F.xxhash64("legislator_id", "rollcall_id") % 2 == 0)
    )
    bad = agreement(p, loop.fit(noise, replace(cfg, cycles=1), START))
    assert abs(bad["r1"]) < 0.5


def test_stopping_rule_and_attempts(panel):
    cfg = FitConfig(
        cycles=6, solver="constrained", rel_tol=1e6, min_cycles=2, patience=2, precision="relaxed"
    )
    fit = loop.fit(panel.votes, cfg, START, panel.seeds_member)
    assert fit.converged and len(fit.trace) == 3
    from rollscale.operators import audit

    row = audit.check_trace(fit.attempts)
    assert row["accepted_infeasible"] == 0 and row["infeasible_evaluations"] == 0
    tried = fit.attempts.where("attempted = 1")
    assert tried.where("objective_evaluations < 2").isEmpty()
    assert not tried.where("feasibility_correction_norm > 0").isEmpty()
    assert fit.attempts.where("attempted = 0 AND status <> 'skipped'").isEmpty()
    broken = fit.attempts.withColumn(
        "raw_return_feasible", (F.col("item_index") % 2 == 0).cast("int")
    )
    with pytest.raises(ValueError, match="infeasible"):
        audit.check_trace(broken)


def test_given_starts_override_and_frozen_parts_stay(panel):
    given = panel.bills.select("rollcall_id", "z1", "z2", "d1", "d2")
    cfg = FitConfig(cycles=1, fix_items=True, fix_globals=True, fix_actors=True)
    seeds = panel.state
    fit = loop.fit(panel.votes, cfg, TRUE_WEIGHTS, None, seeds, given)
    want = panel.scored.agg(F.sum("ll")).first()[0]
    assert fit.trace[0]["log_likelihood"] == pytest.approx(want, abs=1e-6)
    assert fit.weights == TRUE_WEIGHTS


def test_one_dimension_has_no_second_axis(panel):
    fit = loop.fit(panel.votes, FitConfig(cycles=1), Weights(w2=0.0, dims=1), panel.seeds_member)
    assert fit.state.where("x2 <> 0").count() == 0
    assert fit.bills.where("z2 <> 0 or d2 <> 0").count() == 0


class Misled:
    """Rows that lead some groups the wrong way: gradients and ranks are turned round."""

    def __init__(self, rows, groups):
        self.rows, self.groups, self.counts = rows, groups, rows.counts

    def derivatives(self, *args, **kw):
        ll, gradient, info = self.rows.derivatives(*args, **kw)
        return ll, np.where(self.groups[:, None], -gradient, gradient), info

    def candidates(self, thetas, valid):
        found = self.rows.candidates(thetas, valid)
        lies = np.where(np.isfinite(found), -found, found)
        return np.where(self.groups, lies, found)


def member_rows(seed=4, groups=3, size=60):
    from rollscale.functions.kernels import ActorRows, path_basis

    rng = np.random.default_rng(seed)
    number = np.repeat(np.arange(groups), size)
    z, d = rng.uniform(-0.5, 0.5, (len(number), 2)), rng.uniform(0.1, 0.3, (len(number), 2))
    t = rng.choice([-1.0, 0.0, 1.0], len(number))
    vote = 0.6 - z[:, 0] + rng.normal(0, 0.2, len(number)) > 0
    return ActorRows(number, path_basis(t), z, d, vote, groups, START)


def test_a_member_that_loses_fit_gets_its_start_back():
    from rollscale.plans import solvers

    rows, line = member_rows(), FitConfig().line
    start, order = np.full((3, 8), 0.1), np.array([1, 1, 1])
    sound, info = solvers.fit_actors_line(rows, start, order, 2, line)
    assert not info["failed"].any() and (info["final"] >= info["initial"]).all()
    lies = np.array([False, True, False])
    theta, info = solvers.fit_actors_line(Misled(rows, lies), start, order, 2, line)
    assert info["failed"].tolist() == info["accepted"].__invert__().tolist() == lies.tolist()
    assert (theta[1] == start[1]).all() and info["final"][1] == info["initial"][1]
    assert np.allclose(theta[[0, 2]], sound[[0, 2]])
    broken = start.copy()
    broken[2, 0] = np.nan
    theta, info = solvers.fit_actors_line(rows, broken, order, 2, line)
    assert info["failed"].tolist() == [False, False, True] and np.isnan(theta[2, 0])
    assert np.allclose(theta[:2], sound[:2])


def test_failed_members_keep_their_positions_and_are_logged(panel, monkeypatch):
    """A start that is no number fails in its task; the log says so and the fit goes on."""
    from rollscale.operators import trajectory as paths

    whole = paths.start_paths

    def with_a_broken_start(state, *args, **kw):
        found = whole(state, *args, **kw)
        return found.withColumn(
            "b0_1", F.when(F.col("legislator_id") == 3, F.lit(float("nan"))).otherwise(F.col("b0_1"))
        )

    monkeypatch.setattr(loop.trajectory, "start_paths", with_a_broken_start)
    cfg = FitConfig(cycles=1, cut_starts=False, fix_items=True, fix_globals=True)
    fit = loop.fit(panel.votes, cfg, TRUE_WEIGHTS, None, panel.state)
    failed = fit.attempts.where("status = 'failed'").collect()
    assert [r["item_index"] for r in failed] == [3] and failed[0]["accepted"] == 0
    moved = fit.state.alias("a").join(panel.state.alias("b"), ["legislator_id", "period"])
    gap = moved.groupBy("legislator_id").agg(F.max(F.abs(F.col("a.x1") - F.col("b.x1"))).alias("gap"))
    gap = {r["legislator_id"]: r["gap"] for r in gap.collect()}
    assert gap[3] == 0.0 and max(gap.values()) > 1e-3
