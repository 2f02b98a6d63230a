"""Fits; iterative, so they are checked by invariants instead of SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import FitConfig, Precision, Weights
from ..functions import votes
from ..operators import compare, screens, seeds, trajectory
from ..panel import TRUE_WEIGHTS
from ..plans import blocks, loop, scalars
from ..plans.layout import lay_out
from ..session import broadcast_within, cut_lineage
from .base_sql import log_phi
from .catalog import query

START = Weights(w1=1.0, w2=0.45, beta=5.5)
BASE = FitConfig(cycles=2, order=1)
ITEM_COLUMNS = "rollcall_id:l votes:l z1:d z2:d d1:d d2:d ll_before:d ll_after:d accepted:i"
ACTOR_COLUMNS = (
    "legislator_id:l votes:l served:i eff_order:i b0_1:d b0_2:d b1_1:d b1_2:d ll_before:d "
    "ll_after:d accepted:i"
)
FIT_COLUMNS = "legislator_id:l period:i x1:d x2:d true1:d true2:d"


def _usable_votes(p):
    usable = p.bills.where("valid").select("rollcall_id")
    return p.valid_votes.join(usable, "rollcall_id", "left_semi")


def _precision(cfg):
    return Precision.profile(cfg.precision)


def _items(p, cfg):
    """Roll calls fitted against the true positions, from the default starts."""
    return _items_by(p, cfg)[0]


def _items_by(p, *cfgs):
    """One such table per setting, over one layout of the votes."""
    limits = cfgs[0].limits
    layout = lay_out(_usable_votes(p), "rollcall_id", limits, reuse=len(cfgs) > 1)
    state = p.state
    if len(cfgs) > 1:
        state = cut_lineage(state)
        state = broadcast_within(state, state.count(), limits.broadcast_rows)
    margins = cut_lineage(p.margins) if len(cfgs) > 1 else p.margins
    return [
        blocks.fit_items(
            layout, state, loop.start_bills(margins, None, cfg).where("valid"), TRUE_WEIGHTS, cfg, _precision(cfg)
        )
        for cfg in cfgs
    ]


def _actors(p, cfg):
    """Member paths fitted against the true roll calls, from the seeds."""
    layout = lay_out(_usable_votes(p), "legislator_id", cfg.limits)
    start = seeds.assign(p.placements, p.seeds_member, p.seeds_period)
    return blocks.fit_actors(
        layout,
        trajectory.served_grid(p.placements),
        trajectory.start_paths(start, cfg.order),
        p.bills.where("valid"),
        TRUE_WEIGHTS,
        cfg,
        _precision(cfg),
    )


def _rows(p, found: list[dict]):
    return p.spark.createDataFrame(found)


def _star(p):
    return p.star.select("vote", "x1", "x2", "z1", "z2", "d1", "d2")


def _uniform_sql(seed: int, stream: int) -> str:
    state = f"((legislator_id * 69621 + {seed * 7919 + stream * 104729}) % 2147483646 + 1)"
    for _ in range(3):
        state = f"(({state} * 48271) % 2147483647)"
    return f"({state} / 2147483647.0::DOUBLE)"


def _perturbed_sql(x: str, seed: int) -> str:
    noise = f"sqrt(-2.0 * ln({_uniform_sql(seed, 1)})) * cos(2.0 * pi() * {_uniform_sql(seed, 2)})"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(-0.99, least(0.99, {x} + {noise} * 0.3)) END AS {x}"


@query(
    "legislator_id:l x1:d x2:d",
    f"SELECT legislator_id, {_perturbed_sql('x1', 17)}, {_perturbed_sql('x2', 18)} FROM seeds_member",
)
def perturbed_starts(p):
    """Second start for stability runs: noise added, clamped to the square."""
    return votes.perturbed_seeds(p.seeds_member, 17)


@query("matched:l r1:d r2:d first:d second:d")
def fit_seed_stability(p):
    """Correlation of two fits from different starts over one layout of the votes."""
    starts = [p.seeds_member, votes.perturbed_seeds(p.seeds_member, 17)]
    first, second = loop.fit_starts(p.votes, BASE, START, starts)
    named = [
        f.state.select("legislator_id", "period", F.col("x1").alias("coord1D"), F.col("x2").alias("coord2D"))
        for f in (first, second)
    ]
    turned = compare.orient_dim2(named[1], named[0])
    return compare.join_fits(named[0], turned).agg(
        F.count("*").alias("matched"),
        F.corr("a1", "b1").alias("r1"),
        F.corr("a2", "b2").alias("r2"),
        F.lit(first.trace[-1]["log_likelihood"]).alias("first"),
        F.lit(second.trace[-1]["log_likelihood"]).alias("second"),
    )


SCALAR_COLUMNS = "name:s initial:d value:d ll_before:d ll_after:d accepted:i at_bound:i"


# Votes with what does not depend on the scalars: sums and squares of distances, +1 or -1.
FOLDED = """folded AS (SELECT CASE WHEN vote THEN 1.0 ELSE -1.0 END::DOUBLE AS sign,
    yes1 * yes1 AS yes_1, yes2 * yes2 AS yes_2, no1 * no1 AS no_1, no2 * no2 AS no_2
  FROM scored)"""


def scored_at(w2: str, beta: str) -> str:
    """Relation with log_phi of the {rows} at expressions for w2 and beta."""
    gap = f"exp(-(yes_1 + yes_2 * {w2} * {w2})) - exp(-(no_1 + no_2 * {w2} * {w2}))"
    return (
        f"(SELECT *, {log_phi('zc')} AS log_phi FROM (SELECT *, "
        f"greatest(-5.0, least(5.0, ({gap}) * sign * {beta})) AS zc FROM {{rows}}))"
    )


LATTICE = f"""WITH {FOLDED}
SELECT w2, beta, sum(log_phi) AS log_likelihood FROM {scored_at('w2', 'beta')} GROUP BY w2, beta"""


def lattice_sql(w2: str, beta: str) -> str:
    return LATTICE.format(rows=f"folded, (SELECT {w2} AS w2, {beta} AS beta FROM range(0, 17) AS r(i))")


@query("w2:d beta:d log_likelihood:d", lattice_sql("0.5::DOUBLE", "4.0::DOUBLE + i / 4.0"), digits=4)
def scalar_lattice(p):
    """Likelihood along beta."""
    return scalars.lattice(_star(p), TRUE_WEIGHTS, [TRUE_WEIGHTS.w2], [4.0 + i / 4 for i in range(17)])


@query("w2:d beta:d log_likelihood:d", lattice_sql("0.3::DOUBLE + i / 64.0", "6.0::DOUBLE"), digits=4)
def scalar_lattice_w2(p):
    """Likelihood along w2."""
    values = [0.3 + i / 64 for i in range(17)]
    return scalars.lattice(_star(p), TRUE_WEIGHTS, values, [TRUE_WEIGHTS.beta])


@query(
    "w2:d beta:d log_likelihood:d",
    LATTICE.format(
        rows="folded, (SELECT 0.3::DOUBLE + i / 16.0 AS w2, 5.0::DOUBLE + j / 2.0 AS beta "
        "FROM range(0, 5) AS r(i), range(0, 4) AS s(j))"
    ),
    digits=4,
)
def scalar_lattice_joint(p):
    """Both scalars at once."""
    w2s, betas = [0.3 + i / 16 for i in range(5)], [5.0 + j / 2 for j in range(4)]
    return scalars.lattice(_star(p), TRUE_WEIGHTS, w2s, betas)


def _walk_sql(name: str, start: str, h: float, w2: str, beta: str, known: str) -> str:
    """The uphill rule for one scalar, a trial per recursion; w2 and beta are the scalars at the
    value `v`, `known` a relation of one row that they may name."""

    def at(v):
        inner = scored_at(w2.format(v=v), beta.format(v=v))
        return "SELECT sum(log_phi) FROM " + inner.format(rows=f"folded, {known}")

    moved = (
        f"(SELECT *, v + step AS trial FROM {name}_steps "
        f"WHERE k < 15 AND step <> 0 AND abs(step) >= {h!r} / 32768.0), folded, {known}"
    )
    return f"""{name}_probed AS (SELECT start, ({at(start)}) AS first, ({at(f'({start} + {h!r})')}) AS up,
    ({at(f'({start} - {h!r})')}) AS down FROM (SELECT {start} AS start)),
{name}_steps AS (
  SELECT 0 AS k, CASE WHEN up > first THEN start + {h!r} WHEN down > first THEN start - {h!r}
      ELSE start END AS v, greatest(first, CASE WHEN up > first THEN up ELSE down END) AS best,
    CASE WHEN up > first THEN {h!r}::DOUBLE WHEN down > first THEN -{h!r}::DOUBLE ELSE 0.0 END AS step,
    start, first
  FROM {name}_probed
  UNION ALL
  SELECT k + 1, CASE WHEN ll < best THEN v ELSE trial END, greatest(best, ll),
    CASE WHEN ll < best THEN step / 2.0 ELSE step END, start, first
  FROM (SELECT k, v, best, step, start, first, trial, sum(log_phi) AS ll
    FROM {scored_at(w2.format(v='trial'), beta.format(v='trial')).format(rows=moved)}
    GROUP BY k, v, best, step, start, first, trial)),
{name}_found AS (SELECT '{name}' AS name, start AS initial, v AS value, first AS ll_before,
    best AS ll_after FROM {name}_steps ORDER BY k DESC LIMIT 1)"""


WALKS = f"""WITH RECURSIVE {FOLDED},
{_walk_sql('w2', '0.45::DOUBLE', 0.01, '{v}', '5.5', '(SELECT 1) AS one')},
{_walk_sql('beta', '5.5::DOUBLE', 0.1, 'found_w2', '{v}', '(SELECT value AS found_w2 FROM w2_found) AS f')}
SELECT *, 1 AS accepted, 0 AS at_bound FROM w2_found
UNION ALL SELECT *, 1, 0 FROM beta_found"""


@query(SCALAR_COLUMNS, WALKS, digits=4)
def fit_scalars(p):
    return _rows(p, scalars.walk(_star(p), START))


def _box_sql(name: str, start: float, radius: float, w2: str, beta: str, known: str) -> str:
    """The best value in the box around a start: a grid of 40 steps, eight times the neighbours of
    the best point."""
    grid = (
        f"(SELECT *, low + (high - low) * i / 40.0 AS v FROM {name}_boxes, range(0, 41) AS g(i) "
        f"WHERE k < 5), folded, {known}"
    )
    return f"""{name}_boxes AS (
  SELECT 0 AS k, {start - radius!r}::DOUBLE AS low, {start + radius!r}::DOUBLE AS high,
    0.0::DOUBLE AS value, 0.0::DOUBLE AS ll
  UNION ALL
  SELECT any_value(k) + 1, greatest(any_value(low), arg_max(v, ll) - any_value(high - low) / 40.0),
    least(any_value(high), arg_max(v, ll) + any_value(high - low) / 40.0), arg_max(v, ll), max(ll)
  FROM (SELECT k, low, high, v, sum(log_phi) AS ll
    FROM {scored_at(w2.format(v='v'), beta.format(v='v')).format(rows=grid)}
    GROUP BY k, low, high, v)
  GROUP BY k),
{name}_found AS (SELECT '{name}' AS name, {start!r}::DOUBLE AS initial, value, ll AS ll_after
  FROM {name}_boxes ORDER BY k DESC LIMIT 1)"""


BOXES = f"""WITH RECURSIVE {FOLDED},
{_box_sql('w2', 0.45, 0.16, '{v}', '5.5', '(SELECT 1) AS one')},
{_box_sql('beta', 5.5, 1.6, 'found_w2', '{v}', '(SELECT value AS found_w2 FROM w2_found) AS f')}
SELECT name, initial, value, ll_after, 1 AS accepted, 0 AS at_bound,
  (SELECT sum(log_phi) FROM {scored_at('0.45', '5.5').format(rows='folded')}) AS ll_before FROM w2_found
UNION ALL SELECT name, initial, value, ll_after, 1, 0, (SELECT ll_after FROM w2_found) FROM beta_found"""


@query(SCALAR_COLUMNS, BOXES, digits=4)
def fit_scalars_bounded(p):
    return _rows(p, scalars.bounded(_star(p), START, precision=Precision.profile("strict")))


@query(ITEM_COLUMNS)
def fit_rollcalls(p):
    return _items(p, BASE)


@query(ITEM_COLUMNS)
def fit_rollcalls_constrained(p):
    return _items(p, replace(BASE, solver="constrained"))


@query(ACTOR_COLUMNS)
def fit_legislators(p):
    return _actors(p, BASE)


@query(ACTOR_COLUMNS)
def fit_legislators_constrained(p):
    return _actors(p, replace(BASE, solver="constrained"))


SOLVERS = ("line", "constrained")


@query(
    "solver:s rollcall_id:l votes:l inside:i not_worse:i",
    """SELECT solver, rollcall_id, yea + nay AS votes, 1 AS inside, 1 AS not_worse
FROM bills, (VALUES ('line'), ('constrained')) AS s(solver) WHERE valid""",
)
def fit_rollcalls_invariants(p):
    """What holds for every fitted roll call: all its votes read, midpoint in the ball, no loss of
    the constrained fit."""
    found = None
    fits = _items_by(p, *[replace(BASE, solver=solver) for solver in SOLVERS])
    for solver, fitted in zip(SOLVERS, fits, strict=True):
        one = fitted.select(
            F.lit(solver).alias("solver"),
            "rollcall_id",
            "votes",
            F.expr("sqrt(z1 * z1 + z2 * z2) <= 1 + 1e-9").alias("inside"),
            F.expr(f"'{solver}' = 'line' or ll_after >= ll_before").alias("not_worse"),
        )
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "solver:s legislator_id:l served:i votes:l inside:i not_worse:i",
    """SELECT solver, legislator_id, served, coalesce(votes, 0) AS votes, 1 AS inside, 1 AS not_worse
FROM (SELECT legislator_id, count(*) AS served FROM placements GROUP BY 1)
LEFT JOIN (SELECT legislator_id, count(*) AS votes FROM star GROUP BY 1) USING (legislator_id),
  (VALUES ('line'), ('constrained')) AS s(solver)""",
)
def fit_legislators_invariants(p):
    """What holds for every fitted member: periods, all votes read, intercept in the ball, no loss
    of the constrained fit."""
    found = None
    for solver in SOLVERS:
        fitted = _actors(p, replace(BASE, solver=solver))
        one = fitted.select(
            F.lit(solver).alias("solver"),
            "legislator_id",
            "served",
            "votes",
            F.expr("sqrt(b0_1 * b0_1 + b0_2 * b0_2) <= 1 + 1e-9").alias("inside"),
            F.expr(f"'{solver}' = 'line' or ll_after >= ll_before").alias("not_worse"),
        )
        found = one if found is None else found.unionByName(one)
    return found


def _with_truth(p, fit):
    """Fitted positions aligned to the true ones."""
    named = fit.state.select(
        "legislator_id", "period", F.col("x1").alias("coord1D"), F.col("x2").alias("coord2D")
    )
    aligned = compare.align(compare.join_fits(named, p.fit_a))
    return aligned.select(
        "legislator_id",
        "period",
        F.col("aligned1").alias("x1"),
        F.col("aligned2").alias("x2"),
        F.col("b1").alias("true1"),
        F.col("b2").alias("true2"),
    )


def _fit(p, cfg, **kw):
    return loop.fit(p.votes, cfg, START, p.seeds_member, p.seeds_period, **kw)


@query(FIT_COLUMNS)
def fit_dynamic(p):
    return _with_truth(p, _fit(p, BASE))


@query("legislator_id:l period:i x1:d x2:d")
def fit_static(p):
    """All votes as one period, positions constant."""
    one = p.votes.withColumn("period", F.lit(1))
    return loop.fit(one, replace(BASE, order=0), START, p.seeds_member).state


@query("legislator_id:l period:i x1:d x2:d")
def fit_one_dimension(p):
    fit = loop.fit(p.votes, BASE, Weights(w2=0.0, beta=5.5, dims=1), p.seeds_member, p.seeds_period)
    return fit.state


@query("iteration:i log_likelihood:d w2:d beta:d delta_log_likelihood:d")
def fit_converged(p):
    cfg = replace(
        BASE, solver="constrained", cycles=4, rel_tol=0.5, min_cycles=2, patience=2,
        precision="relaxed", adaptive=True,
    )
    return _rows(p, [{k: t[k] for k in t if k != "classification_pct"} for t in _fit(p, cfg).trace])


@query("stage:s log_likelihood:d w2:d beta:d")
def fit_two_stage(p):
    first, second = loop.fit_two_stage(
        p.votes, replace(BASE, cycles=1), START, 1,
        member_seeds=p.seeds_member, period_seeds=p.seeds_period,
    )
    rows = [("line", first), ("constrained", second)]
    return _rows(
        p,
        [
            {"stage": s, **{k: f.trace[-1][k] for k in ("log_likelihood", "w2", "beta")}}
            for s, f in rows
        ],
    )


@query("frozen:s log_likelihood:d w2:d beta:d")
def fit_frozen(p):
    """Freeze switches: globals, roll calls or members held fixed."""
    names = ("fix_globals", "fix_items", "fix_actors")
    cfgs = [replace(BASE, cycles=1, **{name: True}) for name in names]
    fits = loop.fit_variants(p.votes, cfgs, START, p.seeds_member, p.seeds_period)
    return _rows(
        p,
        [
            {"frozen": name, **{k: fit.trace[-1][k] for k in ("log_likelihood", "w2", "beta")}}
            for name, fit in zip(names, fits, strict=True)
        ],
    )


@query("iteration:i block:s blocks:l accepted:l improvement:d")
def fit_attempts(p):
    """Attempt log of a constrained fit, rolled up."""
    fit = _fit(p, replace(BASE, cycles=1, solver="constrained", precision="relaxed"))
    return fit.attempts.groupBy("iteration", "block").agg(
        F.count("*").alias("blocks"),
        F.sum("accepted").alias("accepted"),
        F.sum("improvement").alias("improvement"),
    )


@query("native:d reloaded:d gap:d")
def state_round_trip(p):
    """Write a fit, reload it and score it: the likelihood must not move."""
    from ..session import scratch_path
    from ..sources import sinks, tables
    from ..operators import scoring

    fit = _fit(p, replace(BASE, cycles=1))
    folder = scratch_path(p.spark, "state")
    state = fit.state.withColumn("eff_order", F.lit(1))
    summary = scoring.log_likelihood(
        scoring.score(scoring.star_join(p.valid_votes, fit.state, fit.bills), fit.weights)
    )
    sinks.write_fit(state, screens.zero_invalid(fit.bills), summary, folder)
    coords = tables.read_coordinates(p.spark, f"{folder}/coordinates")
    stored = tables.read_bill_params(p.spark, f"{folder}/bill_parameters")
    numbered = sinks.local_ids(fit.bills.select("rollcall_id", "period"))
    bills = stored.join(
        numbered.select(F.col("period").alias("session"), F.col("local_id").alias("ID"), "rollcall_id"),
        ["session", "ID"],
    )
    reloaded = loop.evaluate(
        p.votes, seeds.rejoin_state(p.placements, coords), bills, fit.weights
    ).first()
    native = fit.trace[-1]["log_likelihood"]
    again = reloaded["log_likelihood"]
    return _rows(p, [{"native": native, "reloaded": again, "gap": abs(native - again)}])
