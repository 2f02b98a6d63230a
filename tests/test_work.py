"""How often and in how many tasks the work is done."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscale.config import FitConfig, Limits, LineSearch, Weights
from rollscale.functions.kernels import ActorRows, ItemRows, Runs, path_basis
from rollscale.functions.probit import ROUGH_GRID, exact_log_phi_np, rough_log_phi_np
from rollscale.panel import Panel
from rollscale.plans import loop, planes, scalars, solvers
from rollscale.plans.layout import lay_out
from rollscale.queries import fits
from rollscale.session import in_scans


@pytest.fixture(scope="module")
def cast(spark):
    """Votes of 12 members on 16 items in two periods, some of them missing."""
    rng = np.random.default_rng(8)
    place, cut = rng.uniform(-0.8, 0.8, 12), rng.uniform(-0.4, 0.4, 16)
    rows = [
        (m + 1, i // 8 + 1, i + 1, None if rng.random() < 0.1 else bool(place[m] + rng.normal(0, 0.2) < cut[i]))
        for m in range(12)
        for i in range(16)
    ]
    schema = "legislator_id bigint, period int, rollcall_id bigint, vote boolean"
    return spark.createDataFrame(rows, schema).localCheckpoint()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with the two tables of the panel."""
    path = str(tmp_path_factory.mktemp("panel"))
    k = F.col("id")
    spark.range(3000).select(
        k.alias("l_orderkey"),
        (k * 7 % 400).alias("l_partkey"),
        (k % 20).alias("l_suppkey"),
        (k % 5 + 1).cast("int").alias("l_linenumber"),
        F.when(k % 2 == 0, "N").otherwise("R").alias("l_returnflag"),
        F.make_timestamp((k % 7 + 1995).cast("int"), F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias(
            "l_shipdate"
        ),
    ).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_partitions_of_cached_cells_follow_the_rows(spark, folder):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 64)
    assert in_scans(many, 1000, 100).rdd.getNumPartitions() == max(cores, 10)
    assert in_scans(many, 1000, 10).rdd.getNumPartitions() == 64
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        cells = Panel(spark, folder).cells
        assert cells.rdd.getNumPartitions() <= cores
        cells.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_of_a_single_pass_get_their_tasks(cast):
    usable = cast.where(F.col("vote").isNotNull())
    layout = lay_out(usable, "rollcall_id", Limits(block_rows=20, least_block_rows=10))
    assert layout.tasks > 4
    assert layout.dealt(layout.small).rdd.getNumPartitions() == layout.tasks
    blocks_of = layout.dealt(layout.small).select("block", F.spark_partition_id().alias("p")).distinct()
    assert blocks_of.groupBy("block").count().agg(F.max("count")).first()[0] == 1


def test_the_histogram_searches_once(spark, folder):
    from rollscale import queries

    found = queries.queries()["iteration_histogram"](spark, folder)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert found.first()["n"] > 0


def test_sums_of_unsorted_rows_and_empty_groups():
    rng = np.random.default_rng(2)
    number, values = rng.choice([0, 2, 5], 90), rng.normal(size=90)
    order = np.argsort(number, kind="stable")
    runs = Runs(number[order], 7)
    assert np.allclose(runs.sum(values[order]), np.bincount(number, values, 7), atol=1e-13)
    assert (runs.at(np.arange(7.0)) == number[order]).all()
    none = Runs(np.zeros(0, dtype=int), 3)
    assert (none.sum(np.zeros(0)) == 0).all() and len(none.at(np.ones(3))) == 0
    x, vote, w = rng.normal(0, 0.4, (90, 2)), rng.random(90) < 0.5, Weights()
    theta, active = rng.normal(0, 0.3, (7, 4)), np.ones(7, bool)
    mixed = ItemRows(number, x, vote, 7, w).derivatives(theta, active, information=True)
    tidy = ItemRows(number[order], x[order], vote[order], 7, w).derivatives(theta, active, information=True)
    for a, b in zip(mixed, tidy, strict=True):
        assert (a == b).all()


def test_fits_of_several_settings_share_a_layout(cast, monkeypatch):
    made = []

    class Counted(loop._Data):
        def __init__(self, *args):
            made.append(self)
            super().__init__(*args)

    monkeypatch.setattr(loop, "_Data", Counted)
    cfg = FitConfig(cycles=1, order=1, cut_starts=False)
    cfgs = [replace(cfg, fix_globals=True), replace(cfg, fix_globals=True, fix_items=True)]
    fits = loop.fit_variants(cast, cfgs, Weights())
    assert len(made) == 1
    for own, fit in zip(cfgs, fits, strict=True):
        alone = loop.fit(cast, own, Weights())
        assert fit.trace[-1]["log_likelihood"] == pytest.approx(alone.trace[-1]["log_likelihood"], rel=1e-9)
    made.clear()
    first, second = loop.fit_two_stage(cast, replace(cfg, fix_globals=True), Weights(), 1)
    assert len(made) == 1
    assert (first.config.solver, second.config.solver) == ("line", "constrained")
    with pytest.raises(ValueError, match="layouts"):
        loop.fit_variants(cast, [cfg, replace(cfg, margin=0.1)], Weights())


def blocks(groups: int, rows: int, w: Weights):
    """Rows of one block of roll calls and one of members."""
    rng = np.random.default_rng(5)
    number, vote = rng.integers(0, groups, rows), rng.random(rows) < 0.6
    x, d = rng.uniform(-0.8, 0.8, (rows, 2)), rng.uniform(-0.5, 0.5, (rows, 2))
    items = ItemRows(number, x, vote, groups, w)
    actors = ActorRows(number, path_basis(rng.choice([-1.0, 0.0, 1.0], rows)), x, d, vote, groups, w)
    return items, actors


def test_leading_candidates_hold_the_best_ones():
    rng = np.random.default_rng(6)
    for w in (Weights(w2=0.45, beta=5.5), Weights(w2=1.3, beta=15.0), Weights(w2=0.0, beta=5.5, dims=1)):
        items, actors = blocks(9, 4000, w)
        for rows, moved in ((items, 0), (items, w.dims), (actors, 0), (actors, w.dims)):
            theta, move = rng.uniform(-0.6, 0.6, (9, 2 * w.dims)), np.zeros((9, 2 * w.dims))
            move[:, moved : moved + w.dims] = rng.normal(0.0, 0.01, (9, w.dims))
            move[3] = 0.0  # a group of ties
            thetas = theta + np.arange(25)[:, None, None] * move
            thetas[20] += 0.01  # one off the line, as after a projection
            valid = rng.random((25, 9)) < 0.9
            valid[:, 8] = False
            full, found = rows.candidates(thetas, valid), rows.leading(thetas, valid)
            asked = found > -np.inf
            assert (asked <= valid).all() and asked[:, :3].sum() < 0.5 * valid[:, :3].sum()
            np.testing.assert_allclose(found[asked], full[asked], rtol=1e-11)
            np.testing.assert_allclose(found.max(axis=0), full.max(axis=0), rtol=1e-11)
            sure = np.arange(8) != 3
            assert (found.argmax(axis=0) == full.argmax(axis=0))[:8][sure].all()
            assert asked[:, 3].sum() == valid[:, 3].sum()


def test_rough_log_phi_is_within_its_error():
    z = np.linspace(-7.0, 7.0, 200_001)
    rough = rough_log_phi_np((z * ROUGH_GRID).astype(np.float32))
    assert np.abs(rough - exact_log_phi_np(z)).max() <= 5e-6
    assert np.isnan(rough_log_phi_np(np.array([0.5, np.nan], dtype=np.float32))).tolist() == [False, True]


def test_a_group_that_stays_is_not_asked_again():
    items, _ = blocks(6, 3000, Weights(w2=0.45, beta=5.5))
    asked = []

    class Watched:
        counts = items.counts

        def derivatives(self, theta, active, information=False):
            asked.append({g: theta[g].tobytes() for g in np.flatnonzero(active)})
            return items.derivatives(theta, active, information)

        candidates = staticmethod(items.candidates)
        leading = staticmethod(items.candidates)

    solvers.fit_items_line(Watched(), np.tile([0.1, 0.0, 0.3, 0.1], (6, 1)), 2, LineSearch())
    last = {}
    for one in asked:
        assert all(last.get(g) != theta for g, theta in one.items())
        last |= one


def test_points_are_ordered_as_by_their_keys():
    rng = np.random.default_rng(7)
    number = np.sort(rng.integers(0, 5, 3000))
    proj = rng.integers(-40, 40, 3000) / 8.0
    proj[::7] *= -0.0
    expected = np.lexsort((np.arange(3000), proj, number))
    assert (planes._by_projection(number, proj, 5) == expected).all()
    proj[5] = np.nan
    assert (planes._by_projection(number, proj, 5) == np.lexsort((proj, number))).all()


def test_scalar_scans_read_folded_votes(panel, monkeypatch):
    star = panel.star.select("vote", "x1", "x2", "z1", "z2", "d1", "d2")
    w, seen = Weights(w2=0.45, beta=5.5), []
    assert scalars.folded(star, w).count() < star.count()

    def watched(votes, w, lines, sums=scalars._pair_sums):
        seen.append(sum(len(betas) for _, betas in lines))
        assert votes.columns == ["votes"]
        return sums(votes, w, lines)

    monkeypatch.setattr(scalars, "_pair_sums", watched)
    scalars.walk(star, w)
    assert seen[0] == 4 * scalars.NEAR_STEPS + 1


def test_both_solvers_share_one_layout(panel, monkeypatch):
    calls = []

    def watched(*args, lay_out=fits.lay_out, **kw):
        calls.append(args)
        return lay_out(*args, **kw)

    monkeypatch.setattr(fits, "lay_out", watched)
    found = fits.fit_rollcalls_invariants(panel)
    assert len(calls) == 1
    assert sorted(r["solver"] for r in found.select("solver").distinct().collect()) == ["constrained", "line"]


def test_known_sizes_give_the_same_layout(panel):
    rows = panel.valid_votes.select("legislator_id", "period", "rollcall_id", "vote")
    sizes = rows.groupBy("rollcall_id").agg(F.count("*").alias("n")).localCheckpoint()
    limits = Limits(group_rows=2)
    counted, known = (lay_out(rows, "rollcall_id", limits, sizes=s) for s in (None, sizes))
    assert (counted.blocks, counted.rows, counted.hot_count) == (known.blocks, known.rows, known.hot_count)
    assert counted.small.exceptAll(known.small).isEmpty() and counted.hot.exceptAll(known.hot).isEmpty()
