"""Runs that are stopped, resumed and long."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscale.config import FitConfig, Weights
from rollscale.plans import blocks, loop

START = Weights(w2=0.45, beta=5.5)
CFG = FitConfig(cycles=4, order=1)


def run(panel, folder, cfg=CFG):
    return loop.fit(panel.votes, cfg, START, panel.seeds_member, panel.seeds_period, run_dir=folder)


def table(df, *keys):
    return df.orderBy(*keys).toPandas()


def test_a_stopped_run_goes_on_where_it_was(panel, tmp_path, monkeypatch):
    whole = run(panel, str(tmp_path / "whole"))
    fit_actors, calls = blocks.fit_actors, []

    def stops_in_cycle_three(*args, **kw):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return fit_actors(*args, **kw)

    folder = str(tmp_path / "stopped")
    with monkeypatch.context() as patch:
        patch.setattr(blocks, "fit_actors", stops_in_cycle_three)
        with pytest.raises(RuntimeError, match="lost"):
            run(panel, folder)
    resumed = run(panel, folder)
    assert [t["iteration"] for t in resumed.trace] == [1, 2, 3, 4]
    for a, b in zip(whole.trace, resumed.trace, strict=True):
        assert all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9) for k in a)
    assert [(r["iteration"], r["name"]) for r in whole.scalars] == [
        (r["iteration"], r["name"]) for r in resumed.scalars
    ]
    keys = ("legislator_id", "period")
    a, b = table(whole.state, *keys), table(resumed.state, *keys)
    assert np.allclose(a[["x1", "x2"]], b[["x1", "x2"]], atol=1e-9)
    a, b = table(whole.bills, "rollcall_id"), table(resumed.bills, "rollcall_id")
    assert np.allclose(a[["z1", "z2", "d1", "d2"]], b[["z1", "z2", "d1", "d2"]], atol=1e-9)
    log = ("iteration", "block", "item_index")
    names = [*log, "status", "final_log_likelihood"]
    a, b = table(whole.attempts.select(names), *log), table(resumed.attempts.select(names), *log)
    assert (a[[*log, "status"]] == b[[*log, "status"]]).all().all()
    assert np.allclose(a["final_log_likelihood"], b["final_log_likelihood"], atol=1e-7)
    # Nothing is left to do, and other settings are another run.
    again = run(panel, folder)
    assert again.trace == resumed.trace
    assert again.classification["correct"] == resumed.classification["correct"]
    with pytest.raises(ValueError, match="other settings"):
        run(panel, folder, replace(CFG, order=0))


def test_storage_and_plans_stay_level(panel, tmp_path):
    cfg = replace(CFG, cut_starts=False, fix_globals=True, order=0)
    cfg = replace(cfg, line=replace(cfg.line, outer_cycles=1, inner_steps=1))
    folder = str(tmp_path / "long")
    sizes = []
    for cycles in (3, 9):
        fit = run(panel, folder, replace(cfg, cycles=cycles))
        assert len(fit.trace) == cycles
        assert fit.attempts.select("iteration").distinct().count() == cycles
        kept = sorted(os.listdir(f"{folder}/state"))
        assert kept == [f"cycle={c}" for c in (cycles - 1, cycles)]
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (fit.attempts, fit.state, fit.bills)]
        sizes.append([plan.count("\n") for plan in plans])
    assert sizes[0] == sizes[1]


def test_a_run_without_a_folder_keeps_its_tables(panel):
    fit = run(panel, None, replace(CFG, cycles=1, cut_starts=False, fix_actors=True))
    assert fit.state.count() == panel.placements.count() and fit.paths is None
    assert fit.attempts.select("block").distinct().collect()[0]["block"] == "rollcall"
    assert fit.attempts.where(F.col("iteration") != 1).isEmpty()


def test_several_starts_share_one_layout(panel_hundredth, monkeypatch):
    from rollscale.functions import votes
    from rollscale.queries import fits

    p, laid_out = panel_hundredth, []
    made = loop._Data
    monkeypatch.setattr(loop, "_Data", lambda *a: laid_out.append(1) or made(*a))
    found = fits.fit_seed_stability(p).first()
    assert laid_out == [1]
    assert found["matched"] == p.placements.count()
    assert found["r1"] > 0.9 and found["first"] != found["second"]
    moved = votes.perturbed_seeds(p.seeds_member, 17)
    again = votes.perturbed_seeds(p.seeds_member.repartition(7), 17)
    assert sorted(moved.collect()) == sorted(again.collect())
    gap = moved.alias("a").join(p.seeds_member.alias("b"), "legislator_id").select(
        F.stddev(F.col("a.x1") - F.col("b.x1")).alias("sd"), F.max(F.abs("a.x1")).alias("most")
    ).first()
    assert 0.2 < gap["sd"] < 0.4 and gap["most"] <= 0.99
