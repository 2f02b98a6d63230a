"""Roll-call and member fits as independent grouped jobs."""

from __future__ import annotations

import time
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FitConfig, Precision, Weights
from ..functions.kernels import ActorRows, ItemRows, path_basis
from . import solvers
from .layout import Layout, hot_groups
from .spread import SpreadActorRows, SpreadItemRows

ITEM_COLUMNS = ["z1", "z2", "d1", "d2"]
BETA_COLUMNS = [f"b{j}_{k}" for j in range(4) for k in (1, 2)]
VARIANCE_COLUMNS = ["v0_1", "v1_1", "c01_1", "v0_2", "v1_2", "c01_2"]

ATTEMPT = (
    "votes bigint, ll_before double, ll_after double, algorithm string, "
    "fallback_used int, objective_evaluations int, attempted int, accepted int, failed int, "
    "raw_return_feasible int, numerical_correction_applied int, "
    "constraint_tolerance double, raw_constraint_violation double, "
    "feasibility_correction_norm double, infeasible_objective_evaluations int, "
    "max_objective_constraint_violation double, elapsed_milliseconds double"
)
ITEM_SCHEMA = (
    "rollcall_id bigint, "
    + ", ".join(f"{c} double" for c in ITEM_COLUMNS)
    + ", spread_steps int, midpoint_steps int, "
    + ATTEMPT
)
ACTOR_SCHEMA = (
    "legislator_id bigint, served int, eff_order int, rescued int, "
    + ", ".join(f"{c} double" for c in BETA_COLUMNS + VARIANCE_COLUMNS)
    + ", "
    + ATTEMPT
)


def _renewed(df: DataFrame) -> DataFrame:
    """Fresh column identities: both sides of a cogroup may stem from one table."""
    return df.toDF(*df.columns)


def _padded(theta: np.ndarray, dims: int, parts: int) -> np.ndarray:
    """groups x (parts * dims) -> groups x (parts * 2) with a zero second dimension."""
    if dims == 2:
        return theta
    out = np.zeros((len(theta), parts * 2))
    out[:, ::2] = theta
    return out


def _attempts(out: pd.DataFrame, info: dict, counts, algorithm: str, tol: float, seconds: float):
    """One row per group as the solver measured it; the time is a group's share of its block."""
    groups = len(out)
    voted = np.asarray(counts) > 0
    out["votes"] = np.asarray(counts).astype("int64")
    out["ll_before"] = info["initial"]
    out["ll_after"] = info["final"]
    out["algorithm"] = algorithm
    out["fallback_used"] = info.get("fallback", np.zeros(groups)).astype("int32")
    out["objective_evaluations"] = info["evaluations"].astype("int32")
    out["attempted"] = voted.astype("int32")
    out["accepted"] = info.get("accepted", voted).astype("int32")
    out["failed"] = info.get("failed", np.zeros(groups)).astype("int32")
    out["raw_return_feasible"] = (info["violation"] <= tol).astype("int32")
    out["numerical_correction_applied"] = info.get("snapped", np.zeros(groups)).astype("int32")
    out["constraint_tolerance"] = tol
    out["raw_constraint_violation"] = info["violation"]
    out["feasibility_correction_norm"] = info["correction"]
    out["infeasible_objective_evaluations"] = info["outside"].astype("int32")
    out["max_objective_constraint_violation"] = info["objective_violation"]
    out["elapsed_milliseconds"] = 1000.0 * seconds / max(groups, 1)
    return out


def _solve_items(rows, keys, start, w: Weights, cfg: FitConfig, precision: Precision):
    began = time.perf_counter()
    dims = w.dims
    begin = start if dims == 2 else start[:, [0, 2]]
    steps = np.zeros((2, len(keys)), dtype=int)
    if cfg.solver == "line":
        theta, info = solvers.fit_items_line(rows, begin, dims, cfg.line)
        steps = info["steps"]
    else:
        free = np.ones(begin.shape, dtype=bool)
        theta, info = solvers.fit_constrained(
            rows, begin, free, dims, w.beta, precision, precision.item_evals
        )
    full = _padded(theta, dims, 2)
    out = pd.DataFrame({"rollcall_id": np.asarray(keys, dtype="int64")})
    out[ITEM_COLUMNS] = full
    out["spread_steps"] = steps[0].astype("int32")
    out["midpoint_steps"] = steps[1].astype("int32")
    return _attempts(
        out, info, rows.counts, cfg.solver, precision.constraint_tol, time.perf_counter() - began
    )


def _item_block(votes: pd.DataFrame, items: pd.DataFrame, *, w, cfg, precision) -> pd.DataFrame:
    items = items.sort_values("rollcall_id")
    keys = items["rollcall_id"].to_numpy()
    if not len(keys):
        return pd.DataFrame(columns=[c.split()[0] for c in ITEM_SCHEMA.split(", ")])
    number = np.searchsorted(keys, votes["rollcall_id"].to_numpy())
    rows = ItemRows(
        number, votes[["x1", "x2"]].to_numpy(), votes["vote"].to_numpy(bool), len(keys), w
    )
    return _solve_items(rows, keys, items[ITEM_COLUMNS].to_numpy(), w, cfg, precision)


def fit_items(
    layout: Layout,
    state: DataFrame,
    bills: DataFrame,
    w: Weights,
    cfg: FitConfig,
    precision: Precision,
) -> DataFrame:
    """Fit every roll call of `bills` (usable ones, with start values).

    The layout holds votes of usable roll calls only.  They are already laid
    out by roll call, so a broadcast `state` costs no shuffle of votes; the numpy block
    sees the votes and the starts side by side.
    """
    placed = layout.small.join(
        state.select("legislator_id", "period", "x1", "x2"), ["legislator_id", "period"]
    ).select("block", "rollcall_id", "vote", "x1", "x2")
    starts = layout.block_of(bills.select("rollcall_id", *ITEM_COLUMNS))
    if layout.hot_count:
        starts = starts.join(layout.hot_keys.select("rollcall_id"), "rollcall_id", "left_anti")
    out = (
        layout.dealt(placed)
        .groupBy("block")
        .cogroup(_renewed(starts).groupBy("block"))
        .applyInPandas(partial(_item_block, w=w, cfg=cfg, precision=precision), ITEM_SCHEMA)
    )
    for hot in hot_groups(layout, cfg.limits, bills):
        start = _starts_of(hot.keys, bills, "rollcall_id", ITEM_COLUMNS)
        hot_rows = hot.rows.join(
            state.select("legislator_id", "period", "x1", "x2"), ["legislator_id", "period"]
        )
        hot_rows = hot_rows.select("rollcall_id", "vote", "x1", "x2").persist()
        rows = SpreadItemRows(hot_rows, "rollcall_id", hot.keys, hot.counts, w)
        frame = _solve_items(rows, rows.keys, start, w, cfg, precision)
        hot_rows.unpersist()
        out = out.unionByName(out.sparkSession.createDataFrame(frame, ITEM_SCHEMA))
    return out


def _starts_of(keys: list, starts: DataFrame, key: str, columns: list[str]) -> np.ndarray:
    """Columns of a table with a row per group, in the order of some of its keys."""
    wanted = starts.sparkSession.createDataFrame([(k,) for k in keys], f"{key} bigint")
    found = {r[key]: [r[c] for c in columns] for r in starts.join(wanted, key).collect()}
    return np.array([found[k] for k in keys])


def _solve_actors(rows, keys, served, order, start, w, cfg: FitConfig, precision):
    began = time.perf_counter()
    dims = w.dims
    begin = start if dims == 2 else start[:, ::2]
    rescued = np.zeros(len(keys), dtype=bool)
    if cfg.solver == "line":
        theta, info = solvers.fit_actors_line(rows, begin, order, dims, cfg.line)
        rescued = info["rescued"]
    else:
        term = np.repeat(np.arange(4), dims)
        free = term[None, :] <= order[:, None]
        theta, info = solvers.fit_constrained(
            rows, np.where(free, begin, 0.0), free, dims, w.beta, precision, precision.actor_evals
        )
    variances = solvers.actor_variances(rows, theta, order, dims, cfg.line)
    out = pd.DataFrame({"legislator_id": np.asarray(keys, dtype="int64")})
    out["served"] = np.asarray(served).astype("int32")
    out["eff_order"] = order.astype("int32")
    out["rescued"] = rescued.astype("int32")
    out[BETA_COLUMNS] = _padded(theta, dims, 4)
    wide = np.zeros((len(keys), 6))
    wide[:, : 3 * dims] = variances.reshape(len(keys), 3 * dims)
    out[VARIANCE_COLUMNS] = wide
    return _attempts(
        out, info, rows.counts, cfg.solver, precision.constraint_tol, time.perf_counter() - began
    )


def _actor_block(votes: pd.DataFrame, actors: pd.DataFrame, *, w, cfg, precision) -> pd.DataFrame:
    actors = actors.sort_values("legislator_id")
    keys = actors["legislator_id"].to_numpy()
    if not len(keys):
        return pd.DataFrame(columns=[c.split()[0] for c in ACTOR_SCHEMA.split(", ")])
    number = np.searchsorted(keys, votes["legislator_id"].to_numpy())
    rows = ActorRows(
        number,
        path_basis(votes["t"].to_numpy()),
        votes[["z1", "z2"]].to_numpy(),
        votes[["d1", "d2"]].to_numpy(),
        votes["vote"].to_numpy(bool),
        len(keys),
        w,
    )
    return _solve_actors(
        rows,
        keys,
        actors["served"].to_numpy(),
        actors["eff_order"].to_numpy(),
        actors[BETA_COLUMNS].to_numpy(),
        w,
        cfg,
        precision,
    )


def fit_actors(
    layout: Layout,
    grid: DataFrame,
    starts: DataFrame,
    bills: DataFrame,
    w: Weights,
    cfg: FitConfig,
    precision: Precision,
) -> DataFrame:
    """Fit every member path against the usable roll calls.

    grid: (legislator_id, period, t); starts: served, eff_order and the start
    coefficients per member.
    """
    params = bills.select("rollcall_id", *ITEM_COLUMNS)
    times = grid.select("legislator_id", "period", "t")
    placed = layout.small.join(params, "rollcall_id").join(times, ["legislator_id", "period"])
    begin = layout.block_of(starts.select("legislator_id", "served", "eff_order", *BETA_COLUMNS))
    if layout.hot_count:
        begin = begin.join(layout.hot_keys.select("legislator_id"), "legislator_id", "left_anti")
    out = (
        layout.dealt(placed.select("block", "legislator_id", "vote", "t", *ITEM_COLUMNS))
        .groupBy("block")
        .cogroup(_renewed(begin).groupBy("block"))
        .applyInPandas(partial(_actor_block, w=w, cfg=cfg, precision=precision), ACTOR_SCHEMA)
    )
    for hot in hot_groups(layout, cfg.limits, starts):
        columns = ["served", "eff_order", *BETA_COLUMNS]
        start = _starts_of(hot.keys, starts, "legislator_id", columns)
        hot_rows = (
            hot.rows.join(params, "rollcall_id")
            .join(times, ["legislator_id", "period"])
            .select("legislator_id", "vote", "t", *ITEM_COLUMNS)
            .persist()
        )
        n_of = {
            r["legislator_id"]: r["n"]
            for r in hot_rows.groupBy("legislator_id").agg(F.count("*").alias("n")).collect()
        }
        counts = [n_of.get(k, 0) for k in hot.keys]
        rows = SpreadActorRows(hot_rows, "legislator_id", hot.keys, counts, w)
        frame = _solve_actors(
            rows, hot.keys, start[:, 0], start[:, 1].astype(int), start[:, 2:], w, cfg, precision
        )
        hot_rows.unpersist()
        out = out.unionByName(out.sparkSession.createDataFrame(frame, ACTOR_SCHEMA))
    return out
