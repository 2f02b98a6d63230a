"""Cutting plane per roll call: turn the normal, re-cut, keep the best turn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..operators.cuts import EDGE, TIE
from .layout import hot_groups, lay_out
from .spread import SpreadCutRows

TURNS = 25
COUNTS = ("correct_low", "error_low", "correct_high", "error_high")
SCHEMA = (
    "rollcall_id bigint, n1 double, n2 double, cut double, polarity string, "
    "correct_low bigint, error_low bigint, correct_high bigint, error_high bigint, "
    "errors bigint, first_errors bigint, classified bigint, turn int"
)


def _by_projection(number, proj, groups):
    """Rows by group and projection; equal ones keep their order."""
    bits = len(proj).bit_length()
    order = np.argsort(proj)
    ranked = proj[order]
    if not len(proj) or np.isnan(ranked[-1]) or int(groups).bit_length() + 2 * bits > 62:
        return np.lexsort((proj, number))
    rank = np.empty(len(proj), dtype=np.int64)
    rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
    # Sorting numbers is far quicker than sorting by several keys.
    key = ((number << bits | rank) << bits) | np.arange(len(proj))
    key.sort()
    return key & ((1 << bits) - 1)


class LocalCutRows:
    """Points of a block of roll calls; vote is 1 yes, 0 no, -1 absent."""

    def __init__(self, number, member, x, vote, groups):
        order = np.lexsort((member, number))
        self.number, self.vote = number[order].astype(np.int64), vote[order]
        self.x = x[order]
        self.groups = groups

    def cut(self, normals, active):
        rows = slice(None) if active.all() else np.flatnonzero(active[self.number])
        number, x, vote = self.number[rows], self.x[rows], self.vote[rows]
        turned = normals[number]
        proj = x[:, 0] * turned[:, 0] + x[:, 1] * turned[:, 1]
        # The rows are sorted by group and member, so only their order in a group changes.
        order = _by_projection(number, proj, self.groups)
        x, vote, proj = x[order], vote[order], proj[order]
        first = np.r_[True, number[1:] != number[:-1]]
        starts = np.flatnonzero(first)
        here = number[starts]
        sizes = np.diff(np.r_[starts, len(number)])
        run = np.repeat(np.arange(len(starts)), sizes)

        def running(flag):
            total = np.cumsum(flag)
            left = total - flag
            left = left - left[starts][run]
            return left, np.add.reduceat(flag, starts)

        yes_left, yes_all = running((vote == 1).astype(np.int64))
        no_left, no_all = running((vote == 0).astype(np.int64))
        before = np.r_[proj[:1], proj[:-1]]
        cut = np.where(first, proj - EDGE, (proj + before) / 2.0)
        err_yes = no_left + yes_all[run] - yes_left
        err_no = yes_left + no_all[run] - no_left
        total = yes_all + no_all
        distance = np.abs(cut)

        def choose(err):
            least = np.minimum.reduceat(err, starts)
            tied = err - least[run] <= TIE * np.maximum(total, 1)[run]
            near = np.where(tied, distance, np.inf)
            nearest = np.minimum.reduceat(near, starts)
            hits = np.flatnonzero(near == nearest[run])
            return hits[np.unique(run[hits], return_index=True)[1]]

        by_yes, by_no = choose(err_yes), choose(err_no)
        yes_low = err_yes[by_yes] <= err_no[by_no]
        pick = np.where(yes_low, by_yes, by_no)
        at = cut[pick]
        yl, nl = yes_left[pick], no_left[pick]
        yr, nr = yes_all - yl, no_all - nl
        low = proj < at[run]
        wrong = (vote >= 0) & ((vote == 1) != (low == yes_low[run]))
        move = np.where(wrong, 0.0, at[run] - proj)
        y = x + move[:, None] * turned
        mean = np.stack([np.add.reduceat(y[:, k], starts) for k in (0, 1)], 1) / sizes[:, None]
        c = y - mean[run]
        found = {
            "cut": at,
            "yes_low": yes_low,
            "errors": np.where(yes_low, err_yes[by_yes], err_no[by_no]),
            "correct_low": np.where(yes_low, yl, nl),
            "error_low": np.where(yes_low, nl, yl),
            "correct_high": np.where(yes_low, nr, yr),
            "error_high": np.where(yes_low, yr, nr),
            "a": np.add.reduceat(c[:, 0] ** 2, starts) / sizes,
            "b": np.add.reduceat(c[:, 0] * c[:, 1], starts) / sizes,
            "c": np.add.reduceat(c[:, 1] ** 2, starts) / sizes,
        }
        out = {}
        for name, values in found.items():
            out[name] = np.zeros(self.groups)
            out[name][here] = values
        return out


def flattest_direction(a, b, c):
    """Unit direction of least variance of a 2x2 covariance, first component >= 0."""
    angle = 0.5 * np.arctan2(2.0 * b, a - c)
    n = np.stack([-np.sin(angle), np.cos(angle)], axis=1)
    flip = (n[:, 0] < 0) | ((n[:, 0] == 0) & (n[:, 1] < 0))
    return np.where(flip[:, None], -n, n)


def find_planes(rows, turns: int = TURNS, log: list | None = None):
    """Best turn of every roll call: fewest errors, the last of the ties.

    `log` gets (turn, groups that were cut, their errors) of every turn.
    """
    groups = rows.groups
    normal = np.tile([1.0, 0.0], (groups, 1))
    active = np.ones(groups, dtype=bool)
    best = {"errors": np.full(groups, np.inf), "turn": np.zeros(groups, dtype=int)}
    best_normal = normal.copy()
    first_errors = None
    for turn in range(turns):
        found = rows.cut(normal, active)
        if log is not None:
            log.append((turn, np.flatnonzero(active), found["errors"][active]))
        if turn == 0:
            first_errors = found["errors"].copy()
        better = active & (found["errors"] <= best["errors"])
        for name, values in found.items():
            best[name] = np.where(better, values, best.get(name, values))
        best["turn"] = np.where(better, turn, best["turn"])
        best_normal = np.where(better[:, None], normal, best_normal)
        active &= found["errors"] > 0
        if not active.any():
            break
        normal = flattest_direction(found["a"], found["b"], found["c"])
    return best_normal, best, first_errors


def _frame(keys, normal, best, first_errors) -> pd.DataFrame:
    out = pd.DataFrame(
        {
            "rollcall_id": np.asarray(keys, dtype="int64"),
            "n1": normal[:, 0],
            "n2": normal[:, 1],
            "cut": best["cut"],
            "polarity": np.where(best["yes_low"] > 0, "yes_low", "no_low"),
        }
    )
    for name in COUNTS:
        out[name] = best[name].astype("int64")
    out["errors"] = best["errors"].astype("int64")
    out["first_errors"] = first_errors.astype("int64")
    out["classified"] = sum(out[c] for c in COUNTS)
    out["turn"] = best["turn"].astype("int32")
    return out


def _rows_of(pdf: pd.DataFrame):
    keys, number = np.unique(pdf["rollcall_id"].to_numpy(), return_inverse=True)
    return keys, LocalCutRows(
        number,
        pdf["legislator_id"].to_numpy(),
        pdf[["x1", "x2"]].to_numpy(),
        pdf["code"].to_numpy(),
        len(keys),
    )


def _block(pdf: pd.DataFrame, turns: int) -> pd.DataFrame:
    keys, rows = _rows_of(pdf)
    return _frame(keys, *find_planes(rows, turns))


def _log_frame(keys, log) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "rollcall_id": np.concatenate([np.asarray(keys)[groups] for _, groups, _ in log]),
            "turn": np.concatenate([np.full(len(groups), turn) for turn, groups, _ in log]),
            "errors": np.concatenate([errors for _, _, errors in log]).astype("int64"),
        }
    )


def _log_block(pdf: pd.DataFrame, turns: int) -> pd.DataFrame:
    keys, rows = _rows_of(pdf)
    log: list = []
    find_planes(rows, turns, log)
    return _log_frame(keys, log)


def _layout(cloud: DataFrame, state: DataFrame, limits: Limits):
    """Points of the cloud (absent members have a null vote) by roll call."""
    points = cloud.select("rollcall_id", "legislator_id", "period", "vote").join(
        state.select("legislator_id", "period", "x1", "x2"), ["legislator_id", "period"]
    )
    code = F.coalesce(F.col("vote").cast("int"), F.lit(-1)).alias("code")
    rows = points.select("rollcall_id", "legislator_id", code, "x1", "x2")
    return lay_out(rows, "rollcall_id", limits)


def turns_taken(
    cloud: DataFrame, state: DataFrame, limits: Limits = Limits(), turns: int = TURNS
) -> DataFrame:
    """(rollcall_id, turn, errors) of every turn that the search for the planes takes."""
    layout = _layout(cloud, state, limits)
    schema = "rollcall_id bigint, turn int, errors bigint"
    taken = layout.dealt(layout.small).groupBy("block").applyInPandas(lambda pdf: _log_block(pdf, turns), schema)
    for hot in hot_groups(layout, limits):
        log: list = []
        find_planes(SpreadCutRows(hot.rows, hot.keys, limits.leaf_rows), turns, log)
        frame = _log_frame(hot.keys, log)
        taken = taken.unionByName(taken.sparkSession.createDataFrame(frame, schema))
    return taken


def cutting_planes(
    cloud: DataFrame, state: DataFrame, limits: Limits = Limits(), turns: int = TURNS
) -> DataFrame:
    """Plane of every roll call of the cloud (absent members have a null vote)."""
    layout = _layout(cloud, state, limits)
    planes = layout.dealt(layout.small).groupBy("block").applyInPandas(lambda pdf: _block(pdf, turns), SCHEMA)
    for hot in hot_groups(layout, limits):
        rows = SpreadCutRows(hot.rows, hot.keys, limits.leaf_rows)
        frame = _frame(hot.keys, *find_planes(rows, turns))
        planes = planes.unionByName(planes.sparkSession.createDataFrame(frame, SCHEMA))
    return planes
