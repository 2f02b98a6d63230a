"""Oversized groups: their votes stay spread, the block kernels run where the votes are.

A task answers for the votes it holds, one vector per group (over candidates, derivatives or
bins); vectors of a group are then added in a fixed order.  All oversized groups of a layout
advance together, so the number of jobs depends on the solver, not on how many they are.
The driver holds what a solver needs per group, and there are at most rows / group_rows of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Weights
from ..functions.kernels import ActorRows, ItemRows, path_basis
from ..operators.cuts import EDGE, TIE
from ..operators.partials import lists, vectors_by_key

def gathered(rows: DataFrame, key: str, keys, part, combine=np.add, finish=None) -> dict:
    """vectors_by_key for the sorted `keys`, at the driver, by place in them; `part` and `finish`
    get places instead of keys."""
    keys = np.asarray(keys)

    def placed(batch, present, number):
        return part(batch, np.searchsorted(keys, present), number)

    last = None
    if finish is not None:

        def last(name, vector):
            return finish(int(np.searchsorted(keys, name)), vector)

    found = vectors_by_key(rows, key, placed, combine, last).toArrow()
    vectors = found.column("vector").combine_chunks()
    places = np.searchsorted(keys, found.column("key").to_numpy()).tolist()
    return {place: vectors[i].values.to_numpy() for i, place in enumerate(places)}


def _doubles(batch, *names) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)


def _votes(batch) -> np.ndarray:
    return batch.column("vote").to_numpy(zero_copy_only=False)


class _SpreadRows:
    """What the solvers ask of a block, asked of all oversized groups at once."""

    def __init__(self, rows: DataFrame, key: str, keys: list, counts: list, w: Weights):
        order = np.argsort(np.asarray(keys, dtype=np.int64))
        if (order != np.arange(len(order))).any():
            raise ValueError("keys must be sorted")
        self.rows, self.key, self.w = rows, key, w
        self.keys = np.asarray(keys, dtype=np.int64)
        self.counts = np.asarray(counts, dtype=float)

    @staticmethod
    def kernel(batch, number, groups: int, w: Weights):
        raise NotImplementedError

    def _matrix(self, found: dict, width: int) -> np.ndarray:
        out = np.zeros((len(self.keys), width))
        for place, vector in found.items():
            out[place] = vector
        return out

    def candidates(self, thetas, valid):
        kernel, w = self.kernel, self.w

        def part(batch, where, number):
            if not valid[:, where].any():
                return [None] * len(where)
            return kernel(batch, number, len(where), w).candidates(thetas[:, where], valid[:, where]).T

        if not valid.any():
            return np.full(valid.shape, -np.inf)
        found = self._matrix(gathered(self.rows, self.key, self.keys, part), len(thetas)).T
        return np.where(valid, found, -np.inf)

    leading = candidates

    def derivatives(self, theta, active, information=False):
        kernel, w, p = self.kernel, self.w, theta.shape[1]
        upper = np.triu_indices(p)

        def part(batch, where, number):
            if not active[where].any():
                return [None] * len(where)
            asked = kernel(batch, number, len(where), w)
            ll, gradient, info = asked.derivatives(theta[where], active[where], information)
            columns = [ll[:, None], gradient]
            if information:
                columns.append(info[:, upper[0], upper[1]])
            return np.hstack(columns)

        width = 1 + p + (len(upper[0]) if information else 0)
        found = self._matrix(gathered(self.rows, self.key, self.keys, part), width)
        info = None
        if information:
            info = np.zeros((len(found), p, p))
            info[:, upper[0], upper[1]] = found[:, 1 + p :]
            info[:, upper[1], upper[0]] = found[:, 1 + p :]
        return found[:, 0], found[:, 1 : 1 + p], info


class SpreadItemRows(_SpreadRows):
    """Rows: rollcall_id, vote, x1, x2."""

    @staticmethod
    def kernel(batch, number, groups, w):
        return ItemRows(number, _doubles(batch, "x1", "x2"), _votes(batch), groups, w)


class SpreadActorRows(_SpreadRows):
    """Rows: legislator_id, vote, t and the roll-call parameters."""

    @staticmethod
    def kernel(batch, number, groups, w):
        return ActorRows(
            number,
            path_basis(batch.column("t").to_numpy(zero_copy_only=False)),
            _doubles(batch, "z1", "z2"),
            _doubles(batch, "d1", "d2"),
            _votes(batch),
            groups,
            w,
        )


@dataclass(frozen=True)
class Span:
    """Points of one roll call that lie between two places of its order.

    The order is by projection, then member.  A span covers projections from low to high or,
    where `at` is a number, the members from low to high whose projection is `at`.  yes, no and
    idx count the points before it, prev is the last projection before it (NaN: none).
    """

    low: float
    high: float
    at: float = np.nan
    yes: float = 0.0
    no: float = 0.0
    idx: float = 0.0
    prev: float = np.nan

    def holds(self, proj, member):
        if np.isnan(self.at):
            return (proj >= self.low) & (proj <= self.high), proj
        return (proj == self.at) & (member >= self.low) & (member <= self.high), member


BINS = 512
#: Counted per bin: yes, no, all points, least and greatest coordinate.
COUNTED = 5


class _Surviving:
    """Which bins of a roll call can still hold a cut that is chosen.

    Walking through a bin changes the errors by at most its yes (or no) votes, so the counts at
    its start bound all of its cuts; the cut at its first point is one of them.
    """

    def __init__(self, yes_all, no_all, best=(np.inf, np.inf)):
        self.yes_all, self.no_all, self.best = yes_all, no_all, list(best)

    def bounds(self, yes, no, yes_in, no_in):
        """(at the first point, least possible) errors for the polarities yes_low and no_low."""
        first = no + self.yes_all - yes, yes + self.no_all - no
        return first, (first[0] - yes_in, first[1] - no_in)

    def keep(self, yes, no, yes_in, no_in):
        total = self.yes_all + self.no_all
        slack = TIE * max(total, 1.0)
        first, least = self.bounds(yes, no, yes_in, no_in)
        self.best = [min(b, f.min(initial=np.inf)) for b, f in zip(self.best, first)]
        stay = np.zeros(len(yes), bool)
        for mine, other in ((0, 1), (1, 0)):
            # A polarity is out once the other one is sure to have fewer errors.
            if least[mine].min(initial=np.inf) <= self.best[other] + slack:
                stay |= least[mine] <= self.best[mine] + slack
        return stay


def _edges(span: Span) -> np.ndarray:
    edges = np.linspace(span.low, span.high, BINS + 1)
    return edges if np.isnan(span.at) else np.ceil(edges)


class SpreadCutRows:
    """Rows: rollcall_id, legislator_id, code (1 yes, 0 no, -1 absent), x1, x2.

    The best cut is found by counting: a histogram along the axis bounds the errors of all cuts in
    a bin, only bins that may hold the best one are counted again in finer bins, and those of at
    most `leaf_rows` points are sorted, each by itself.  The counts are whole numbers, so the
    result is the one of a full sort; rounds grow with the logarithm of the votes.
    """

    def __init__(self, rows: DataFrame, keys: list, leaf_rows: int = 4096):
        self.rows, self.leaf_rows = rows, leaf_rows
        self.keys = np.asarray(keys, dtype=np.int64)
        self.groups = len(keys)

        def reach(batch, where, number):
            x = _doubles(batch, "x1", "x2")
            far = np.zeros(len(where))
            np.maximum.at(far, number, np.sqrt((x * x).sum(axis=1)))
            return far[:, None]

        found = gathered(rows, "rollcall_id", self.keys, reach, np.maximum)
        self.reach = {place: float(v[0]) * (1 + 1e-9) + 1e-9 for place, v in found.items()}

    def _points(self, normals):
        """(batch, number) -> projection, member and code of every point and the rows by group."""

        def points(batch, where, number):
            proj = (_doubles(batch, "x1", "x2") * normals[where][number]).sum(axis=1)
            member = batch.column("legislator_id").to_numpy().astype(np.float64)
            return proj, member, batch.column("code").to_numpy()

        return points

    def _count(self, normals, spans, totals):
        """Counts the bins of all spans; what survives, as new spans with their number of points."""
        points = self._points(normals)

        def part(batch, where, number):
            proj, member, code = points(batch, where, number)
            out = []
            for local, place in enumerate(where.tolist()):
                if place not in spans:
                    out.append(None)
                    continue
                mine = number == local
                vectors = []
                for span in spans[place]:
                    inside, coordinate = span.holds(proj[mine], member[mine])
                    c, v = coordinate[inside], code[mine][inside]
                    bin_of = np.clip(np.searchsorted(_edges(span), c, "right") - 1, 0, BINS - 1)
                    low, high = np.full(BINS, np.inf), np.full(BINS, -np.inf)
                    np.minimum.at(low, bin_of, c)
                    np.maximum.at(high, bin_of, c)
                    counts = [np.bincount(bin_of[v == k], minlength=BINS) for k in (1, 0)]
                    counts.append(np.bincount(bin_of, minlength=BINS))
                    vectors.append(np.stack([*counts, low, high]).astype(float))
                out.append(np.concatenate(vectors).reshape(-1))
            return out

        def combine(a, b):
            a, b = a.reshape(-1, COUNTED, BINS), b.reshape(-1, COUNTED, BINS)
            joined = a + b
            joined[:, 3] = np.minimum(a[:, 3], b[:, 3])
            joined[:, 4] = np.maximum(a[:, 4], b[:, 4])
            return joined.reshape(-1)

        def finish(place, vector):
            counted = vector.reshape(-1, COUNTED, BINS)
            if place in totals:
                yes_all, no_all, *best = totals[place]
            else:  # the first round counts every point
                (yes_all, no_all), best = counted[0, :2].sum(axis=1), (np.inf, np.inf)
            surviving = _Surviving(yes_all, no_all, best)
            bins = []
            for span, (yes, no, size, low, high) in zip(spans[place], counted, strict=True):
                some = np.flatnonzero(size > 0)
                yes, no, size, low, high = (v[some] for v in (yes, no, size, low, high))
                if np.isnan(span.at):
                    prev = np.concatenate([[span.prev], high[:-1]])
                else:
                    prev = np.concatenate([[span.prev], np.full(len(some), span.at)])[: len(some)]
                before = [start + np.cumsum(v) - v for start, v in ((span.yes, yes), (span.no, no), (span.idx, size))]
                bins.append(np.stack([low, high, np.full(len(some), span.at), *before, prev, yes, no, size]))
            bins = np.concatenate(bins, axis=1)
            bins = bins[:, surviving.keep(bins[3], bins[4], bins[7], bins[8])]
            return np.concatenate([[yes_all, no_all, *surviving.best], bins.T.reshape(-1)])

        found = gathered(self.rows, "rollcall_id", self.keys, part, combine, finish)
        out = {}
        for place, vector in found.items():
            totals[place] = tuple(vector[:4])
            out[place] = [(Span(*b[:7]), b[9]) for b in vector[4:].reshape(-1, 10)]
        return out

    def _leaves(self, normals, active):
        """Spans of at most leaf_rows points that hold every cut which may be chosen, and the
        votes of their roll calls."""
        spans = {g: [Span(-r, r)] for g, r in self.reach.items() if active[g]}
        totals, leaves = {}, {}
        while spans:
            found, spans = self._count(normals, spans, totals), {}
            for place, kept in found.items():
                for span, size in kept:
                    if size <= self.leaf_rows or (span.low == span.high and not np.isnan(span.at)):
                        leaves.setdefault(place, []).append(span)
                    elif span.low == span.high:  # equal projections: go on by member
                        members = replace(span, at=span.low, low=-(2.0**53), high=2.0**53)
                        spans.setdefault(place, []).append(members)
                    else:
                        spans.setdefault(place, []).append(span)
        return leaves, totals

    def _best(self, normals, leaves, totals):
        """Per roll call and polarity the chosen cut: errors, distance, idx, cut, yes and no before."""
        points = self._points(normals)
        keys = self.keys

        def gather(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                present, number = np.unique(batch.column("rollcall_id").to_numpy(), return_inverse=True)
                where = np.searchsorted(keys, present)
                proj, member, code = points(batch, where, number)
                for local, place in enumerate(where.tolist()):
                    mine = np.flatnonzero(number == local)
                    for leaf, span in enumerate(leaves.get(place, ())):
                        at = mine[span.holds(proj[mine], member[mine])[0]]
                        if len(at):
                            yield pa.record_batch(
                                {
                                    "place": pa.array(np.full(len(at), place), pa.int32()),
                                    "leaf": pa.array(np.full(len(at), leaf), pa.int32()),
                                    "proj": proj[at],
                                    "member": member[at],
                                    "code": pa.array(code[at], pa.int32()),
                                }
                            )

        def choose(table):
            place, leaf = (table.column(c)[0].as_py() for c in ("place", "leaf"))
            span, (yes_all, no_all, *_) = leaves[place][leaf], totals[place]
            proj, member, code = (table.column(c).to_numpy() for c in ("proj", "member", "code"))
            order = np.lexsort((member, proj))
            proj, code = proj[order], code[order]
            yes, no = ((code == k).astype(float) for k in (1, 0))
            yes, no = span.yes + np.cumsum(yes) - yes, span.no + np.cumsum(no) - no
            before = np.concatenate([[span.prev], proj[:-1]])
            cut = np.where(np.isnan(before), proj - EDGE, (proj + before) / 2.0)
            idx, distance = span.idx + np.arange(len(proj)), np.abs(cut)
            kept = []
            for polarity, errors in ((0, no + yes_all - yes), (1, yes + no_all - no)):
                # Of each number of errors within the tolerance the nearest cut, then the first.
                near = np.flatnonzero(errors <= errors.min() + TIE * max(yes_all + no_all, 1.0))
                near = near[np.lexsort((idx[near], distance[near], errors[near]))]
                near = near[np.unique(errors[near], return_index=True)[1]]
                for i in near:
                    kept.append([polarity, errors[i], distance[i], idx[i], cut[i], yes[i], no[i]])
            return pa.table(
                {
                    "place": pa.array([place] * len(kept), pa.int32()),
                    "vector": lists([np.array(v, dtype=float) for v in kept]),
                }
            )

        schema = "place int, leaf int, proj double, member double, code int"
        chosen_schema = "place int, vector array<double>"
        found = self.rows.mapInArrow(gather, schema).groupBy("place", "leaf")
        found = found.applyInArrow(choose, chosen_schema).toArrow()
        by_place: dict = {}
        vectors = found.column("vector").combine_chunks()
        for i, place in enumerate(found.column("place").to_pylist()):
            by_place.setdefault(place, []).append(vectors[i].values.to_numpy())
        chosen = {}
        for place, options in by_place.items():
            options, slack = np.array(options), TIE * max(sum(totals[place][:2]), 1.0)
            best = []
            for polarity in (0, 1):
                mine = options[options[:, 0] == polarity][:, 1:]
                tied = mine[mine[:, 0] - mine[:, 0].min() <= slack]
                best.append(tied[np.lexsort((tied[:, 2], tied[:, 1]))[0]])
            chosen[place] = (best[0][0] <= best[1][0], best)
        return chosen

    def _spread_of_moved(self, normals, cut, yes_low, active):
        """Centred second moments after every right voter has moved to the plane."""
        points = self._points(normals)

        def part(batch, where, number):
            proj, _, code = points(batch, where, number)
            x, n, at = _doubles(batch, "x1", "x2"), normals[where][number], cut[where][number]
            wrong = (code >= 0) & ((code == 1) != ((proj < at) == yes_low[where][number]))
            y = x + np.where(wrong, 0.0, at - proj)[:, None] * n
            out = []
            for local, place in enumerate(where.tolist()):
                if not active[place]:
                    out.append(None)
                    continue
                here = y[number == local]
                mean = here.mean(axis=0)
                a, b = (here - mean).T
                out.append(np.array([len(here), *mean, (a * a).sum(), (a * b).sum(), (b * b).sum()]))
            return out

        def combine(p, q):
            n = p[0] + q[0]
            gap = q[1:3] - p[1:3]
            mean = p[1:3] + gap * (q[0] / n)
            outer = np.array([gap[0] ** 2, gap[0] * gap[1], gap[1] ** 2])
            return np.concatenate([[n], mean, p[3:] + q[3:] + outer * (p[0] * q[0] / n)])

        return gathered(self.rows, "rollcall_id", self.keys, part, combine)

    def cut(self, normals, active):
        names = (
            "cut", "yes_low", "errors", "correct_low", "error_low",
            "correct_high", "error_high", "a", "b", "c",
        )
        out = {name: np.zeros(self.groups) for name in names}
        out["yes_low"] = np.zeros(self.groups, dtype=bool)
        leaves, totals = self._leaves(normals, active)
        for place, (yes_low, best) in self._best(normals, leaves, totals).items():
            errors, _, _, cut, yes, no = best[0 if yes_low else 1]
            right = totals[place][0] - yes, totals[place][1] - no
            sides = ((yes, no), right[::-1]) if yes_low else ((no, yes), right)
            out["yes_low"][place], out["cut"][place], out["errors"][place] = yes_low, cut, errors
            out["correct_low"][place], out["error_low"][place] = sides[0]
            out["correct_high"][place], out["error_high"][place] = sides[1]
        moved = self._spread_of_moved(normals, out["cut"], out["yes_low"], active)
        for place, (n, _, _, a, b, c) in moved.items():
            out["a"][place], out["b"][place], out["c"][place] = a / n, b / n, c / n
        return out
