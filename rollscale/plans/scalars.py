"""Global scalars: likelihood at a lattice of (w2, beta) per scan, then two search rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Precision, Weights
from ..functions import probit
from ..functions.ball import bound_rule
from ..session import ship_package

# First step, bounds and local box of the two scalars.
STEPS = {"beta": 0.1, "w2": 0.01}
BOUNDS = {"beta": (0.05, 20.0), "w2": (0.01, 2.0)}
LOCAL_RADIUS = {"beta": 1.6, "w2": 0.16}
UPHILL_STEPS = 15
NEAR_STEPS = 3  # lattice steps on each side fetched with the first scan
HALVINGS = 32768.0
GRID = 6  # steps across the box in one scan of the bounded search
NARROW = 1e-4  # relative width of a box in which a grid without gain ends the search
LATTICE = "place int, ll double"


def folded(star: DataFrame, w: Weights) -> DataFrame:
    """What the scans need of the votes: squared distances from the point that was chosen and from
    the other one, per dimension. A row holds a batch of votes, so a scan unpacks no single ones."""
    ship_package(star.sparkSession)
    first = w.w1 * w.w1

    def fold(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x1, x2, z1, z2, d1, d2 = (
                batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("x1", "x2", "z1", "z2", "d1", "d2")
            )
            vote = batch.column("vote").to_numpy(zero_copy_only=False).astype(bool)
            yes, no = first * (x1 - z1 + d1) ** 2, first * (x1 - z1 - d1) ** 2
            yes2, no2 = (x2 - z2 + d2) ** 2, (x2 - z2 - d2) ** 2
            near, near2 = np.where(vote, yes, no), np.where(vote, yes2, no2)
            far, far2 = np.where(vote, no, yes), np.where(vote, no2, yes2)
            packed = pa.array([np.stack([near, far, near2, far2]).tobytes()], pa.binary())
            yield pa.record_batch([packed], names=["votes"])

    names = ("vote", "x1", "x2", "z1", "z2", "d1", "d2")
    return star.select(*names).mapInArrow(fold, "votes binary")


def _pair_sums(votes: DataFrame, w: Weights, lines: list[tuple[float, list[float]]]) -> DataFrame:
    """(place, log_likelihood) of every w2 with each of its betas, in order, in one scan of the folded
    votes.

    A value of w2 costs two exponentials and a value of beta one log Phi. A task adds up its votes and
    sends a number per pair.
    """
    flat = w.dims < 2

    def sums(batches):
        total = np.zeros(sum(len(betas) for _, betas in lines))
        for batch in batches:
            for packed in batch.column("votes"):
                near, far, near2, far2 = np.frombuffer(packed.as_buffer()).reshape(4, -1)
                at = 0
                for w2, betas in lines:
                    second = 0.0 if flat else w2 * w2
                    gap = np.exp(-(near + near2 * second)) - np.exp(-(far + far2 * second))
                    low, high = gap[gap <= 0], gap[gap > 0]  # beta is positive
                    for beta in betas:
                        total[at] += probit.log_phi_sum_np(low * beta, high * beta)
                        at += 1
        yield pa.record_batch(
            [pa.array(range(len(total)), pa.int32()), pa.array(total)],
            names=["place", "ll"],
        )

    return votes.mapInArrow(sums, LATTICE).groupBy("place").agg(F.sum("ll").alias("log_likelihood"))


def lattice(star: DataFrame, w: Weights, w2s: list[float], betas: list[float]) -> DataFrame:
    """(w2, beta, log_likelihood) of every pair."""
    n = len(betas)
    pairs = [(i * n + j, float(a), float(b)) for i, a in enumerate(w2s) for j, b in enumerate(betas)]
    named = star.sparkSession.createDataFrame(pairs, "place int, w2 double, beta double")
    lines = [(float(a), [float(b) for b in betas]) for a in w2s]
    return F.broadcast(named).join(_pair_sums(folded(star, w), w, lines), "place").drop("place")


class Surface:
    """Remembers likelihoods; missing ones are fetched together with likely next ones.

    The folded votes are kept for the scans, on disk where memory is short; the joins behind them
    are run once.
    """

    def __init__(self, star: DataFrame, w: Weights):
        self.votes, self.w = folded(star, w).persist(StorageLevel.MEMORY_AND_DISK), w
        self.known: dict[tuple[float, float], float] = {}
        self.scans = 0

    def __enter__(self) -> "Surface":
        return self

    def __exit__(self, *_) -> None:
        self.votes.unpersist()

    def fetch(self, w2s, betas) -> None:
        """All pairs, unless they are known."""
        w2s, betas = sorted({float(v) for v in w2s}), sorted({float(v) for v in betas})
        w2s = [a for a in w2s if any((a, b) not in self.known for b in betas)]
        betas = [b for b in betas if any((a, b) not in self.known for a in w2s)]
        if w2s and betas:
            self._scan([(a, betas) for a in w2s])

    def cross(self, w2s, betas) -> None:
        """The first w2 with all betas, the others with the first beta only."""
        self._scan([(float(w2s[0]), [float(b) for b in betas])] + [(float(a), [float(betas[0])]) for a in w2s[1:]])

    def _scan(self, lines) -> None:
        self.scans += 1
        pairs = [(a, b) for a, betas in lines for b in betas]
        for r in _pair_sums(self.votes, self.w, lines).collect():
            self.known[pairs[r["place"]]] = r["log_likelihood"]

    def line(self, name: str, other: float) -> dict[float, float]:
        """What is known along one scalar, the other one being fixed."""
        if name == "w2":
            return {a: ll for (a, b), ll in self.known.items() if b == other}
        return {b: ll for (a, b), ll in self.known.items() if a == other}

    def along(self, name: str, other: float, values) -> None:
        pairs = (values, [other]) if name == "w2" else ([other], values)
        self.fetch(*pairs)


def _uphill(value: float, h: float, moves: int):
    """Values a walk in steps of h reaches if every move succeeds."""
    out = []
    for _ in range(moves):
        value += h
        out.append(value)
    return out


def _bracket(value: float, h: float):
    """Values the next four halving decisions can ask for: all lie below value + 2h."""
    return [value + h * i / 8.0 for i in range(1, 16)]


def _vertex(points: dict[float, float], best: float) -> list[float]:
    """Peak of the parabola through the best value and its two neighbours."""
    known = sorted(points)
    i = known.index(best)
    if not 0 < i < len(known) - 1:
        return []
    a, b, c = known[i - 1 : i + 2]
    fa, fb, fc = (points[v] for v in (a, b, c))
    bend = (b - a) * (fb - fc) - (b - c) * (fb - fa)
    if bend == 0.0:
        return []
    peak = b - 0.5 * ((b - a) ** 2 * (fb - fc) - (b - c) ** 2 * (fb - fa)) / bend
    return [peak] if a < peak < c else []


def _near(value: float, h: float) -> list[float]:
    return [value, *_uphill(value, h, NEAR_STEPS), *_uphill(value, -h, NEAR_STEPS)]


def _walk(surface: Surface, name: str, start: float, other: float) -> dict:
    """Probe both sides, walk uphill, halve the step after a decrease."""
    scans = surface.scans
    h = STEPS[name]
    smallest = h / HALVINGS

    def ask(value, likely=()):
        known = surface.line(name, other)
        if value not in known:
            surface.along(name, other, [value, *likely])
            known = surface.line(name, other)
        return known[value]

    first = ask(start, _near(start, h))
    value, best = start, first
    up, down = ask(start + h), ask(start - h)
    for sign, probe in ((1.0, up), (-1.0, down)):
        if probe <= first or value != start:
            continue
        step = sign * h
        value, best = start + step, probe
        for _ in range(UPHILL_STEPS):
            trial = value + step
            whole = abs(step) == h
            ll = ask(
                trial,
                _uphill(value, step, UPHILL_STEPS + 1) if whole else _bracket(value, step),
            )
            if ll < best:
                step /= 2.0
            else:
                value, best = trial, max(best, ll)
            if abs(step) < smallest:
                break
    return {
        "name": name,
        "initial": start,
        "value": value,
        "ll_before": first,
        "ll_after": best,
        "scans": surface.scans - scans,
        "accepted": 1,
        "at_bound": 0,
    }


def walk(star: DataFrame, w: Weights, names=("w2", "beta")) -> list[dict]:
    """The sequential uphill rule for w2, then for beta; only the evaluations are batched.

    The first scan takes the steps around both starts, each at the start of the other scalar, so
    beta costs no scan of its own where w2 stays, as it does in calm cycles.
    """
    with Surface(star, w) as surface:
        return _walks(surface, w, [n for n in names if n == "beta" or w.dims > 1])


def _walks(surface: Surface, w: Weights, names: list[str]) -> list[dict]:
    out = []
    if len(names) > 1:
        surface.cross(_near(w.w2, STEPS["w2"]), _near(w.beta, STEPS["beta"]))
    first = surface.scans
    for name in names:
        other = w.beta if name == "w2" else w.w2
        found = _walk(surface, name, getattr(w, name), other)
        found["scans"], first = found["scans"] + first, 0
        w = w.with_value(name, found["value"])
        out.append(found)
    return out


class _Box:
    """Nested grids along one scalar: the box shrinks to the neighbours of the best value."""

    def __init__(self, name: str, start: float, scope: str, precision: Precision):
        low, high = BOUNDS[name]
        self.name, self.precision, self.stop = name, precision, ""
        self.start = self.value = min(max(start, low), high)
        radius = LOCAL_RADIUS[name]
        local = max(low, self.start - radius), min(high, self.start + radius)
        self.outer = self.low, self.high = (low, high) if scope == "global" else local
        self.known: dict[float, float] = {}
        self.asked: set[float] = set()
        self.vertex: list[float] = []

    def grid(self) -> list[float]:
        """What to ask for next: the grid of the box, the start, the best so far, the vertex."""
        out = [self.start, self.value]
        # Room for the start and the vertex; a grid needs an inner point.
        points = min(GRID, self.precision.scalar_evals - len(self.asked) - 3)
        if not self.stop and points < 2:
            self.stop = "budget"
        if self.stop:
            return out
        if not self.known:  # denser near the start, which is near the best value in later cycles
            ends = (self.low, self.high)
            shares = [0.25**k for k in range(points // 2 + 1)]
            out += [self.start + (end - self.start) * share for end in ends for share in shares]
        else:
            step = (self.high - self.low) / points
            self.vertex = _vertex(self.known, self.value)
            out += [*(self.low + step * i for i in range(points + 1)), *self.vertex]
        self.asked |= set(out)
        return out

    def see(self, known: dict[float, float], settled: bool = True) -> None:
        """Takes in a line of likelihoods; without `settled` the line may still move, so the box
        only shrinks."""
        if self.stop:
            return
        before = known[self.value] if self.known else None
        self.known, self.value = known, max(known, key=known.get)
        best, order = known[self.value], sorted(known)
        at = order.index(self.value)
        # The optimum lies next to the best grid point and nearer to the best vertex; at an end of
        # what is known it may lie anywhere beyond.
        near = 0.25 if self.value in self.vertex else 1.0
        width = self.high - self.low
        below = near * (self.value - order[at - 1]) if at else width
        above = near * (order[at + 1] - self.value) if at + 1 < len(order) else width
        self.low = max(self.outer[0], self.value - below)
        self.high = min(self.outer[1], self.value + above)
        if not settled:
            return
        width, size = self.high - self.low, max(1.0, abs(self.value))
        gain = None if before is None else best - before
        if width <= self.precision.x_tol * size:
            self.stop = "x"
        elif gain is not None and gain <= self.precision.f_tol * max(1.0, abs(best)):
            # The clamp of log Phi makes kinks, so a wide box may hide more than its grid shows.
            self.stop = "f" if width <= NARROW * size else ""

    def report(self, known: dict[float, float], scans: int) -> dict:
        low, high = BOUNDS[self.name]
        bound = bound_rule(self.value, low, high, self.precision.constraint_tol)
        first, value = known[self.start], self.value
        last = known[value]
        # Only a value inside the bounds that loses nothing is accepted, as it stands.
        accepted = bound["feasible"] and not bound["corrected"] and last >= first
        if not accepted:
            value, last = self.start, first
        return {
            "name": self.name,
            "initial": self.start,
            "value": value,
            "ll_before": first,
            "ll_after": last,
            "scans": scans,
            "evaluations": len(self.asked),
            "stop": self.stop,
            "accepted": int(accepted),
            "violation": bound["violation"],
            "at_bound": int(value <= low or value >= high),
        }


def bounded(
    star: DataFrame,
    w: Weights,
    names=("w2", "beta"),
    scope: str = "local",
    precision: Precision | None = None,
) -> list[dict]:
    """Best w2 inside its box, then best beta at that w2; each kept only if the likelihood holds.

    Both boxes shrink together, a scan of their joint grid at a time, until they are narrower than
    the x tolerance ("x"), a finer grid of a narrow box gains no more than the f tolerance ("f"),
    all relative, or the evaluations are spent ("budget"); `stop` says which.
    """
    names = [n for n in names if n == "beta" or w.dims > 1]
    with Surface(star, w) as surface:
        return _boxes(surface, w, names, scope, precision or Precision.profile())


def _boxes(surface: Surface, w: Weights, names: list[str], scope: str, precision: Precision) -> list[dict]:
    boxes = {n: _Box(n, getattr(w, n), scope, precision) for n in names}
    first, beta = boxes.get("w2"), boxes.get("beta")
    old_beta = beta.start if beta else w.beta
    while any(not b.stop for b in boxes.values()):
        w2s = first.grid() if first else [w.w2]
        betas = beta.grid() if beta else [w.beta]
        surface.fetch(w2s, betas)
        if first:
            line = surface.line("w2", old_beta)
            first.see({a: line[a] for a in w2s})
        if beta:
            # The best w2 so far is part of every scan, so it has met all betas of this one.
            line = surface.line("beta", first.value if first else w.w2)
            beta.see({b: line[b] for b in betas}, first is None or bool(first.stop))
    out = []
    if first:
        out.append(first.report(surface.line("w2", old_beta), surface.scans))
        w = w.with_value("w2", out[0]["value"])
    if beta:
        surface.fetch([w.w2], [beta.start, beta.value])
        out.append(beta.report(surface.line("beta", w.w2), 0 if first else surface.scans))
    return out
