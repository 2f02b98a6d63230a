"""The alternating fit: scalars, roll calls, members, cycle after cycle."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FitConfig, Precision, Weights
from ..operators import cuts, screens, scoring, seeds, trajectory
from ..session import broadcast_within, cut_lineage, in_scans
from . import blocks, planes, scalars
from .layout import lay_out
from .runs import RunStore


#: Votes that a partition of the scalar scans should hold.
SCAN_ROWS = 200_000
#: Fits over one layout that run side by side.
FITS_AT_ONCE = 2


@dataclass
class Fit:
    """Tables of a finished fit."""

    weights: Weights
    config: FitConfig
    state: DataFrame
    bills: DataFrame
    paths: DataFrame | None
    trace: list[dict]
    attempts: DataFrame | None
    scalars: list[dict]
    classification: dict
    converged: bool
    seconds: float
    phases: dict = field(default_factory=dict)


class _Data:
    """Votes of one fit in the layouts the phases need."""

    def __init__(self, votes: DataFrame, cfg: FitConfig):
        votes = screens.period_range(votes, cfg.first_period, cfg.last_period)
        votes = votes.select("legislator_id", "period", "rollcall_id", "vote")
        self.kept = votes.persist(StorageLevel.MEMORY_AND_DISK)
        votes = in_scans(self.kept, self.kept.count(), cfg.limits.scan_rows)
        self.cfg = cfg
        self.cells = votes
        self.margins = cut_lineage(screens.margins(votes))
        self.placements = cut_lineage(screens.placements(votes))
        self.n_items = self.margins.count()
        self.n_placements = self.placements.count()
        usable = self.margins.where(screens.passes_margin(cfg.margin)).select("rollcall_id")
        self.valid = (
            screens.drop_missing(votes)
            .select("legislator_id", "period", "rollcall_id", "vote")
            .join(self.items(usable), "rollcall_id", "left_semi")
        )
        sizes = (
            self.margins.join(usable, "rollcall_id", "left_semi")
            .groupBy("rollcall_id")
            .agg(F.sum(F.col("yea") + F.col("nay")).alias("n"))
        )
        self.by_item = lay_out(self.valid, "rollcall_id", cfg.limits, reuse=True, sizes=sizes)
        self.by_actor = lay_out(self.valid, "legislator_id", cfg.limits, reuse=True)
        self.n_valid = self.by_item.rows

    def items(self, df: DataFrame) -> DataFrame:
        """Mark a table with a row per roll call for broadcast if it is small."""
        return broadcast_within(df, self.n_items, self.cfg.limits.broadcast_rows)

    def actors(self, df: DataFrame) -> DataFrame:
        """Same for a table with at most a row per placement."""
        return broadcast_within(df, self.n_placements, self.cfg.limits.broadcast_rows)

    def star(self, state: DataFrame, bills: DataFrame) -> DataFrame:
        votes = self.by_item.small.drop("block")
        if self.by_item.hot is not None:
            votes = votes.unionByName(self.by_item.hot)
        return scoring.star_join(votes, self.actors(state), self.items(bills))

    def release(self) -> None:
        self.kept.unpersist()
        self.by_item.release()
        self.by_actor.release()


def start_bills(margins: DataFrame, given: DataFrame | None, cfg: FitConfig) -> DataFrame:
    """Default starts (midpoint 0, spread 0.3), overridden by supplied parameters."""
    base = margins.select("rollcall_id", "period", "yea", "nay")
    names = blocks.ITEM_COLUMNS
    defaults = {"z1": 0.0, "z2": 0.0, "d1": 0.3, "d2": 0.3}
    if given is None:
        out = base.withColumns({c: F.lit(v) for c, v in defaults.items()})
    else:
        complete = given.dropna(subset=names).select(
            "rollcall_id", *[F.col(c).alias(f"given_{c}") for c in names]
        )
        out = base.join(complete, "rollcall_id", "left").select(
            *base.columns,
            *[F.coalesce(F.col(f"given_{c}"), F.lit(defaults[c])).alias(c) for c in names],
        )
    return screens.mark_valid(out, cfg.margin)


def _flat(df: DataFrame, dims: int) -> DataFrame:
    """A one-dimensional fit keeps its second columns at zero."""
    if dims == 2:
        return df
    second = [c for c in ("x2", "z2", "d2") if c in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in second})


def cut_bills(data: _Data, state: DataFrame, bills: DataFrame, w: Weights) -> DataFrame:
    """Starts from cuts for roll calls whose midpoint was not supplied."""
    cfg = data.cfg
    cloud = data.cells.join(
        data.items(bills.where("valid").select("rollcall_id")), "rollcall_id", "left_semi"
    )
    if w.dims == 1:
        points = cloud.join(data.actors(state), ["legislator_id", "period"]).withColumn(
            "proj", F.col("x1")
        )
        best = cuts.best_cuts(points, cfg.limits).withColumns(
            {"n1": F.lit(1.0), "n2": F.lit(0.0)}
        )
    else:
        best = planes.cutting_planes(cloud, data.actors(state), cfg.limits)
    starts = cuts.starts_from_cuts(best)
    names = blocks.ITEM_COLUMNS
    renamed = starts.select("rollcall_id", *[F.col(c).alias(f"cut_{c}") for c in names])
    empty = F.col("z1") * F.col("z1") + F.col("z2") * F.col("z2") <= 1e-10
    joined = bills.join(renamed, "rollcall_id", "left")
    use = empty & F.col("cut_z1").isNotNull()
    return joined.select(
        *[c for c in bills.columns if c not in names],
        *[F.when(use, F.col(f"cut_{c}")).otherwise(F.col(c)).alias(c) for c in names],
    )


def _joined(data: _Data, state: DataFrame, bills: DataFrame) -> DataFrame:
    """Votes with their parameters, for one likelihood and the scalar scans after it.

    The scans keep what they need of them, so the joined rows are not cached.
    """
    star = data.star(state, bills).select("vote", "x1", "x2", "z1", "z2", "d1", "d2")
    # Scans of few votes in many small partitions would be all overhead.
    cores = star.sparkSession.sparkContext.defaultParallelism
    return star.coalesce(max(cores, data.n_valid // SCAN_ROWS))


def _likelihood(star: DataFrame, w: Weights) -> dict:
    return scoring.log_likelihood(scoring.score(star, w)).first().asDict()


def _fit_scalars(star, w, cfg, budget, cycle, phases) -> tuple[Weights, list[dict]]:
    """w2, then beta."""
    tick = time.perf_counter()
    if cfg.solver == "line":
        found = scalars.walk(star, w)
    else:
        found = scalars.bounded(star, w, scope=cfg.scalar_scope, precision=budget)
    for one in found:
        w = w.with_value(one["name"], one["value"])
    phases["scalars"] += time.perf_counter() - tick
    rows = [{"iteration": cycle, **one} for one in found]
    return w, rows


def _update_bills(bills: DataFrame, fitted: DataFrame) -> DataFrame:
    names = blocks.ITEM_COLUMNS
    new = fitted.select("rollcall_id", *[F.col(c).alias(f"new_{c}") for c in names])
    return bills.join(new, "rollcall_id", "left").select(
        *[c for c in bills.columns if c not in names],
        *[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) for c in names],
    )


def attempt_rows(fitted: DataFrame, block: str, key: str, cycle: Column) -> DataFrame:
    return fitted.select(
        cycle.alias("iteration"),
        F.lit(block).alias("block"),
        F.col(key).alias("item_index"),
        "algorithm",
        "fallback_used",
        "objective_evaluations",
        F.when(F.col("attempted") == 0, "skipped")
        .when(F.col("failed") == 1, "failed")
        .when(F.col("accepted") == 1, "accepted")
        .otherwise("rejected")
        .alias("status"),
        F.col("ll_before").alias("initial_log_likelihood"),
        F.col("ll_after").alias("final_log_likelihood"),
        (F.col("ll_after") - F.col("ll_before")).alias("improvement"),
        "elapsed_milliseconds",
        "attempted",
        "accepted",
        "raw_return_feasible",
        "numerical_correction_applied",
        "constraint_tolerance",
        "raw_constraint_violation",
        "feasibility_correction_norm",
        "infeasible_objective_evaluations",
        "max_objective_constraint_violation",
    )


def fit(
    votes: DataFrame,
    cfg: FitConfig = FitConfig(),
    weights: Weights = Weights(),
    member_seeds: DataFrame | None = None,
    period_seeds: DataFrame | None = None,
    given_bills: DataFrame | None = None,
    run_dir: str | None = None,
) -> Fit:
    """Run the alternating fit on long votes (legislator_id, period, rollcall_id, vote).

    Every cycle is written to `run_dir`, a shared folder (without one, to a folder of its own in
    the shared scratch space).  If it holds full cycles of a run with the same settings, the fit
    goes on after the last of them; more cycles may be asked for than the first run had.
    """
    began = time.perf_counter()
    settings = repr((replace(cfg, cycles=0), weights))
    store = RunStore(votes.sparkSession, run_dir, settings)
    data = _Data(votes, cfg)
    try:
        return _alternate(data, cfg, weights, member_seeds, period_seeds, given_bills, began, store)
    finally:
        data.release()


def fit_starts(
    votes: DataFrame,
    cfg: FitConfig,
    weights: Weights,
    member_starts: list[DataFrame],
    period_seeds: DataFrame | None = None,
    given_bills: DataFrame | None = None,
) -> list[Fit]:
    """One fit per table of member starts; the votes are counted and laid out once for all.

    The fits run side by side, so that one has tasks for the cores that the other one leaves idle.
    """
    settings = repr((replace(cfg, cycles=0), weights))
    data = _Data(votes, cfg)

    def run(starts: DataFrame) -> Fit:
        store = RunStore(votes.sparkSession, None, settings)
        began = time.perf_counter()
        return _alternate(data, cfg, weights, starts, period_seeds, given_bills, began, store)

    try:
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            return list(pool.map(run, member_starts))
    finally:
        data.release()


def fit_variants(
    votes: DataFrame,
    cfgs: list[FitConfig],
    weights: Weights,
    member_seeds: DataFrame | None = None,
    period_seeds: DataFrame | None = None,
    given_bills: DataFrame | None = None,
) -> list[Fit]:
    """One fit per setting; they may differ in what a cycle does, not in votes, margin or limits, so
    the votes are counted and laid out once for all."""
    first = cfgs[0]
    if any(_laid_by(cfg) != _laid_by(first) for cfg in cfgs):
        raise ValueError("the settings need other layouts")
    data = _Data(votes, first)
    try:
        return [
            _alternate(
                data,
                cfg,
                weights,
                member_seeds,
                period_seeds,
                given_bills,
                time.perf_counter(),
                RunStore(votes.sparkSession, None, repr((replace(cfg, cycles=0), weights))),
            )
            for cfg in cfgs
        ]
    finally:
        data.release()


def _laid_by(cfg: FitConfig) -> tuple:
    """What the layout of the votes depends on."""
    return cfg.first_period, cfg.last_period, cfg.margin, cfg.limits


def _attempts(store: RunStore) -> DataFrame | None:
    """The log of all blocks and cycles, as the solvers measured them."""
    out = None
    for name, block, key in (
        ("items", "rollcall", "rollcall_id"),
        ("members", "legislator", "legislator_id"),
    ):
        fitted = store.log(name)
        if fitted is not None:
            rows = attempt_rows(fitted, block, key, F.col("cycle").cast("int"))
            out = rows if out is None else out.unionByName(rows)
    return out


def _begin(data, cfg, w, member_seeds, period_seeds, given_bills, store):
    """State and roll calls before the first cycle, or after the last full one."""
    last = store.last_cycle
    if last:
        bills = store.read("bills", 1 if cfg.cut_starts and not cfg.fix_items else 0)
        state = store.read("state", 0 if cfg.fix_actors else last)
        return state, bills
    state = seeds.assign(data.placements, member_seeds, period_seeds).select(
        "legislator_id", "period", "x1", "x2"
    )
    bills = start_bills(data.margins, given_bills, cfg)
    return (
        store.write(_flat(state, w.dims), "state", 0),
        store.write(_flat(bills, w.dims), "bills", 0),
    )


def _alternate(data, cfg, weights, member_seeds, period_seeds, given_bills, began, store) -> Fit:
    phases = {"layout": time.perf_counter() - began, "starts": 0.0}
    phases |= {"scalars": 0.0, "items": 0.0, "actors": 0.0, "likelihood": 0.0}
    last = store.last_cycle
    w = weights
    state, stored_bills = _begin(data, cfg, w, member_seeds, period_seeds, given_bills, store)
    bills = stored_bills
    grid = cut_lineage(trajectory.served_grid(data.placements))
    paths = star = None
    classification: dict = {}
    streak, previous, converged = 0, None, False
    trace = [r["trace"] for r in store.records]
    scalar_rows = [row for r in store.records for row in r["scalars"]]
    if last:
        record = store.records[-1]
        streak, previous, converged = record["streak"], trace[-1]["log_likelihood"], record["converged"]
        w = replace(w, w2=trace[-1]["w2"], beta=trace[-1]["beta"])
        if not cfg.fix_items:
            bills = _update_bills(stored_bills, store.read("items", last))
        if not cfg.fix_actors:
            paths = store.read("members", last)
    precision = Precision.profile(cfg.precision)

    for cycle in range(last + 1, cfg.cycles + 1):
        if converged:
            break
        rows = []
        budget = precision.for_cycle(cycle, 1, cfg.cycles, cfg.adaptive)
        if not cfg.fix_globals:
            if star is None:
                star = _joined(data, state, bills)
            w, rows = _fit_scalars(star, w, cfg, budget, cycle, phases)
            scalar_rows += rows
        if not cfg.fix_items:
            tick = time.perf_counter()
            if cycle == 1 and cfg.cut_starts:
                bills = stored_bills = store.write(cut_bills(data, state, bills, w), "bills", 1)
                phases["starts"] = time.perf_counter() - tick
                tick = time.perf_counter()
            usable = bills.where("valid")
            fitted = blocks.fit_items(data.by_item, data.actors(state), usable, w, cfg, budget)
            fitted = store.write(fitted, "items", cycle)
            # Every cycle refits all usable roll calls, so this joins two stored tables
            # and needs no checkpoint of its own.
            bills = _update_bills(stored_bills, fitted)
            phases["items"] += time.perf_counter() - tick
        if cycle == cfg.cycles and not cfg.fix_items:
            # The reported classification is the one of the last roll-call phase.
            classification = _likelihood(data.star(state, bills), w)
        if not cfg.fix_actors:
            tick = time.perf_counter()
            starts = trajectory.start_paths(state, cfg.order, grid)
            fitted = blocks.fit_actors(
                data.by_actor,
                data.actors(grid),
                starts,
                data.items(bills.where("valid")),
                w,
                cfg,
                budget,
            )
            fitted = store.write(fitted, "members", cycle)
            # A failed member keeps the positions it had.
            sound = fitted.where("failed = 0")
            moved = trajectory.reconstruct(sound, data.placements, grid=grid).select(
                "legislator_id", "period", "x1", "x2"
            )
            paths = fitted
            state = store.write(_keep_unfitted(state, moved), "state", cycle)
            phases["actors"] += time.perf_counter() - tick
        tick = time.perf_counter()
        star = _joined(data, state, bills)
        overall = _likelihood(star, w)
        phases["likelihood"] += time.perf_counter() - tick
        ll = overall["log_likelihood"]
        gain = None if previous is None else ll - previous
        trace.append(
            {
                "iteration": cycle,
                "log_likelihood": ll,
                "w2": w.w2,
                "beta": w.beta,
                "delta_log_likelihood": 0.0 if gain is None else gain,
                "classification_pct": overall["classification_pct"],
            }
        )
        watching = cfg.abs_tol > 0 or cfg.rel_tol > 0
        if cfg.solver == "constrained" and watching and gain is not None and gain < -1e-8:
            raise RuntimeError(f"log-likelihood fell between cycles by {-gain}")
        threshold = cfg.abs_tol + cfg.rel_tol * max(1.0, abs(previous or 0.0))
        calm = (
            watching
            and gain is not None
            and cycle >= cfg.min_cycles
            and 0.0 <= gain <= threshold
        )
        streak = streak + 1 if calm else 0
        previous = ll
        converged = watching and streak >= cfg.patience
        store.finish(
            cycle,
            {"trace": trace[-1], "scalars": rows, "streak": streak, "converged": converged},
        )
        if not cfg.fix_actors:
            store.drop_before("state", cycle)

    if not classification:
        classification = _likelihood(data.star(state, bills), w) if star is None else overall
    return Fit(
        w,
        cfg,
        state,
        bills,
        paths,
        trace,
        _attempts(store),
        scalar_rows,
        classification,
        converged,
        time.perf_counter() - began,
        phases,
    )


def _keep_unfitted(state: DataFrame, moved: DataFrame) -> DataFrame:
    """Members without a usable vote, or whose fit failed, keep their position."""
    new = moved.select(
        "legislator_id", "period", F.col("x1").alias("new1"), F.col("x2").alias("new2")
    )
    return state.join(new, ["legislator_id", "period"], "left").select(
        "legislator_id",
        "period",
        F.coalesce("new1", "x1").alias("x1"),
        F.coalesce("new2", "x2").alias("x2"),
    )


def evaluate(
    votes: DataFrame,
    state: DataFrame,
    bills: DataFrame,
    w: Weights,
    margin: float = 0.025,
) -> DataFrame:
    """Score a supplied state without fitting: one lazy row of counters."""
    usable = screens.mark_valid(
        bills.select("rollcall_id", *blocks.ITEM_COLUMNS).join(
            screens.margins(votes), "rollcall_id"
        ),
        margin,
    )
    star = scoring.star_join(screens.drop_missing(votes), state, usable)
    return scoring.log_likelihood(scoring.score(star, w))


def fit_two_stage(
    votes: DataFrame,
    cfg: FitConfig,
    weights: Weights,
    polish_cycles: int = 2,
    **starts: DataFrame | None,
) -> tuple[Fit, Fit]:
    """Line-search fit, then a constrained polish from its state, over one layout of the votes."""
    line = replace(cfg, solver="line")
    polish = replace(cfg, solver="constrained", cycles=polish_cycles, cut_starts=False)

    def run(own, w, **given):
        given = {"member_seeds": None, "period_seeds": None, "given_bills": None, **given}
        store = RunStore(votes.sparkSession, None, repr((replace(own, cycles=0), w)))
        return _alternate(data, own, w, **given, began=time.perf_counter(), store=store)

    data = _Data(votes, cfg)
    try:
        first = run(line, weights, **starts)
        second = run(polish, first.weights, period_seeds=first.state, given_bills=first.bills)
    finally:
        data.release()
    return first, second
