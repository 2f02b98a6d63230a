"""Block solvers: all groups of a block advance in step.

A `rows` object answers three questions for many groups at once: `counts`,
`derivatives(theta, active)` and `candidates(thetas, valid)`; where it has `leading(thetas, valid)`,
that may leave out candidates that are surely not the best.  It is either a numpy block inside a
task or a Spark job over oversized groups.
"""

from __future__ import annotations

import numpy as np

from ..config import LineSearch, Precision
from ..functions.kernels import bounded_inverse, project_first
from ..functions.spatial import GRAD_SCALE
from ..operators.records import rescue_points


def _gmp(ll, counts):
    return np.exp(ll / np.maximum(counts, 1))


def _line_points(theta, direction, columns, norm, cfg, points, ball):
    """Candidates along a descent direction; a ball search ends at its first exit."""
    unit = np.where(norm < 1e-10, cfg.step, cfg.step / np.maximum(norm, 1e-300))
    shift = (np.arange(points)[:, None] * unit)[..., None] * direction[None]
    thetas = np.repeat(theta[None], points, axis=0)
    thetas[..., columns] = theta[None][..., columns] - shift
    valid = np.ones(thetas.shape[:2], dtype=bool)
    if ball:
        thetas, outside = project_first(thetas, len(columns))
        exits_before = np.cumsum(outside, axis=0) - outside
        valid = exits_before == 0
    return thetas, valid


class _Gains:
    """Stops a group when, from the third step on, the gain gets small."""

    def __init__(self, groups, tol):
        self.last = np.zeros(groups)
        self.tol = tol

    def small(self, step, gmp):
        stop = (step >= 2) & (gmp - self.last <= self.tol)
        self.last = gmp
        return stop


class _Watch:
    """What a solver asks of the objective: evaluations, and those outside the ball.

    The first `dims` parameters belong in the unit ball; an excess is a squared radius above 1.
    """

    TOLERANCE = 1e-10

    def __init__(self, groups, dims):
        self.dims = dims
        self.evaluations = np.zeros(groups, dtype=int)
        self.outside = np.zeros(groups, dtype=int)
        self.violation = np.zeros(groups)
        self.correction = np.zeros(groups)

    def excess(self, thetas):
        return np.maximum(0.0, (thetas[..., : self.dims] ** 2).sum(axis=-1) - 1.0)

    def see(self, thetas, asked):
        """Points x groups x parameters, of which `asked` are evaluated."""
        excess = np.where(asked, self.excess(thetas), 0.0)
        self.evaluations += asked.sum(axis=0)
        self.outside += (excess > self.TOLERANCE).sum(axis=0)
        self.violation = np.maximum(self.violation, excess.max(axis=0))

    def corrected(self, raw, kept, moved):
        """Groups that moved to a point which a projection took from `raw` to `kept`."""
        norm = np.sqrt(((raw - kept) ** 2).sum(axis=1))
        self.correction = np.maximum(self.correction, np.where(moved, norm, 0.0))

    def report(self, theta):
        return {
            "evaluations": self.evaluations,
            "violation": self.excess(theta),
            "correction": self.correction,
            "outside": self.outside,
            "objective_violation": self.violation,
        }


class _Memory:
    """Rows of a line search; a group that has not moved gets the answer of its last question."""

    def __init__(self, rows):
        self.rows, self.counts = rows, rows.counts
        self.ask_line = getattr(rows, "leading", rows.candidates)
        self.theta = None
        self.lines: dict = {}

    def derivatives(self, theta, active):
        if self.theta is None or self.theta.shape != theta.shape:
            self.theta = np.full(theta.shape, np.nan)
            self.ll, self.gradient = np.zeros(len(theta)), np.zeros(theta.shape)
        ask = active & (self.theta != theta).any(axis=1)
        if ask.any():
            ll, gradient, _ = self.rows.derivatives(theta, ask)
            self.theta = np.where(ask[:, None], theta, self.theta)
            self.ll = np.where(ask, ll, self.ll)
            self.gradient = np.where(ask[:, None], gradient, self.gradient)
        return np.where(active, self.ll, 0.0), np.where(active[:, None], self.gradient, 0.0), None

    def leading(self, kind, thetas, valid):
        """Candidates x groups; `kind` tells the lines that are remembered apart."""
        known = self.lines.get(kind)
        if known is None or known[0].shape != thetas.shape:
            known = np.full(thetas.shape, np.nan), np.zeros_like(valid), np.full(valid.shape, -np.inf)
        lines, asked, found = known
        moved = (lines != thetas).any(axis=(0, 2)) | (asked != valid).any(axis=0)
        ask = valid & moved
        if ask.any():
            found = np.where(moved, self.ask_line(thetas, ask), found)
            lines, asked = np.where(moved[:, None], thetas, lines), np.where(moved, valid, asked)
            self.lines[kind] = lines, asked, found
        return np.where(valid, found, -np.inf)


def fit_items_line(rows, start: np.ndarray, dims: int, cfg: LineSearch):
    """Alternate spread and midpoint line searches per roll call."""
    rows = _Memory(rows)
    theta = start.copy()
    counts = rows.counts
    voted = counts > 0
    n = np.maximum(counts, 1)[:, None]
    watch = _Watch(len(theta), dims)
    watch.see(theta[None], voted[None])
    first = rows.derivatives(theta, voted)[0]
    mid, spr = list(range(dims)), list(range(dims, 2 * dims))
    steps = np.zeros((2, len(theta)), dtype=int)

    def reset_small(active):
        small = (np.abs(theta[:, spr]) <= cfg.min_spread) & active[:, None]
        theta[:, spr] = np.where(small, cfg.reset_spread, theta[:, spr])
        return small.any(axis=1)

    def phase(columns, is_spread):
        active = voted.copy()
        gains = _Gains(len(theta), cfg.gain_tol)
        for step in range(cfg.inner_steps):
            if not active.any():
                break
            if is_spread:
                reset_small(active)
            ll, gradient, _ = rows.derivatives(theta, active)
            direction = gradient[:, columns] / n
            gmp = _gmp(ll, counts)
            moving = active.copy()
            if is_spread:
                moving &= (np.abs(direction) > cfg.zero_gradient).any(axis=1)
            norm = np.sqrt((direction**2).sum(axis=1))
            thetas, valid = _line_points(
                theta, direction, columns, norm, cfg, cfg.points, not is_spread
            )
            watch.see(thetas, valid & moving)
            found = rows.leading(is_spread, thetas, valid & moving)
            best = found.argmax(axis=0)  # first of the ties
            at = np.arange(len(theta))
            theta[moving] = thetas[best, at][moving]
            gmp = np.where(moving, _gmp(found[best, at], counts), gmp)
            steps[0 if is_spread else 1] += active
            stop = gains.small(step, gmp) | ~moving
            if is_spread:
                stop |= reset_small(moving)
            active &= ~stop

    for _ in range(cfg.outer_cycles):
        phase(spr, True)
        phase(mid, False)
    final = rows.derivatives(theta, voted)[0]
    return theta, {"initial": first, "final": final, "steps": steps, **watch.report(theta)}


def fit_actors_line(rows, start, order, dims: int, cfg: LineSearch):
    """Constant, then linear, quadratic and cubic terms, each searched alone.

    start: groups x (4 * dims) least-squares coefficients; order: term allowed per
    group.  Later terms start from zero.

    A group is a transaction: if a term ends with a geometric mean probability more than
    `cfg.gmp_drop` below the one it began with, or the start is not finite, the group failed
    and its start comes back unchanged.
    """
    groups = len(start)
    grid_rows, rows = rows, _Memory(rows)
    counts = rows.counts
    broken = ~np.isfinite(start).all(axis=1)
    voted = (counts > 0) & ~broken
    failed = (counts > 0) & broken
    n = np.maximum(counts, 1)[:, None]
    theta = np.zeros_like(start)
    theta[:, :dims] = np.where(broken[:, None], 0.0, start[:, :dims])
    norm = np.sqrt((theta[:, :dims] ** 2).sum(axis=1))
    theta[:, :dims] *= np.where(norm > 1.0, cfg.interior / np.maximum(norm, 1e-300), 1.0)[:, None]
    watch = _Watch(groups, dims)
    watch.corrected(np.where(broken[:, None], 0.0, start[:, :dims]), theta[:, :dims], voted)
    watch.see(theta[None], voted[None])
    initial = final = rows.derivatives(theta[:, :dims], voted)[0]
    rescued = np.zeros(groups, dtype=bool)

    for term in range(4):
        allowed = voted & (order >= term) & ~failed
        if not allowed.any():
            break
        saved = np.zeros(groups)
        width = (term + 1) * dims
        columns = list(range(term * dims, width))
        points = cfg.points if term == 0 else cfg.temporal_points
        active = allowed.copy()
        gains = _Gains(groups, cfg.gain_tol)
        for step in range(cfg.inner_steps):
            if not active.any():
                break
            current = theta[:, :width]
            ll, gradient, _ = rows.derivatives(current, active)
            if term == 0 and step == 0 and dims == 2:
                low = active & (_gmp(ll, counts) < cfg.rescue_gmp)
                if low.any():
                    rescued = low
                    grid = rescue_points()
                    tried = np.repeat(current[None], len(grid), axis=0)
                    tried[..., :2] = grid[:, None, :]
                    asked = np.broadcast_to(low, tried.shape[:2])
                    watch.see(tried, asked)
                    found = grid_rows.candidates(tried, asked)
                    theta[low, :2] = grid[found.argmax(axis=0)][low]
                    current = theta[:, :width]
                    ll, gradient, _ = rows.derivatives(current, active)
            if step == 0:
                saved = _gmp(ll, counts)
            direction = gradient[:, columns] / n
            norm = np.sqrt((direction**2).sum(axis=1))
            moving = active & (norm > 0)
            thetas, valid = _line_points(
                current, direction, columns, norm, cfg, points, term == 0
            )
            watch.see(thetas, valid & moving)
            found = rows.leading(term, thetas, valid & moving)
            best = len(found) - 1 - found[::-1].argmax(axis=0)  # last of the ties
            at = np.arange(groups)
            theta[moving, :width] = thetas[best, at][moving]
            gmp = np.where(moving, _gmp(found[best, at], counts), _gmp(ll, counts))
            active &= moving & ~gains.small(step, gmp)
        found = rows.derivatives(theta[:, :width], allowed)[0]
        final = np.where(allowed, found, final)
        failed |= allowed & ~(_gmp(final, counts) >= saved - cfg.gmp_drop)
    theta = np.where(failed[:, None], start, theta)
    return theta, {
        "initial": initial,
        "final": np.where(failed, initial, final),
        "failed": failed,
        "accepted": voted & ~failed,
        "rescued": rescued,
        "snapped": watch.correction > 0,
        **watch.report(theta),
    }


def fit_constrained(rows, start, free, dims: int, beta: float, precision: Precision, budget: int):
    """Maximise each block's likelihood with the first `dims` parameters in the ball.

    Damped steps on the summed outer products, several step lengths per pass; a
    normalised-gradient step is the second method.  Only non-decreasing, finite,
    feasible points are ever kept.  `free` masks the parameters a group may move.
    """
    groups, p = start.shape
    counts = rows.counts
    voted = counts > 0
    theta, snapped = project_first(start, dims)
    watch = _Watch(groups, dims)
    watch.corrected(start, theta, voted)
    watch.see(theta[None], voted[None])
    ll = rows.derivatives(theta, voted)[0]
    initial = ll.copy()
    damping = np.full(groups, 1e-3)
    active = voted.copy()
    fallback = np.zeros(groups, dtype=bool)
    spent = np.ones(groups, dtype=int)
    lengths = np.array([2.0, 1.0, 0.5, 0.25, 0.0625])
    eye = np.eye(p)
    scale = GRAD_SCALE * beta
    while active.any():
        _, term, info = rows.derivatives(theta, active, information=True)
        gradient = np.where(free, scale * term, 0.0)
        mask = free[:, :, None] & free[:, None, :]
        curvature = np.where(mask, scale * scale * info, 0.0)
        size = np.maximum(np.einsum("gii->gi", curvature).max(axis=1), 1e-8)
        ridge = (damping * size)[:, None, None] * eye + 1e-10 * eye
        newton = np.linalg.solve(curvature + ridge, gradient[..., None])[..., 0]
        # Nothing in the model lives farther than a unit step away.
        newton /= np.maximum(1.0, np.sqrt((newton**2).sum(axis=1)))[:, None]
        norm = np.maximum(np.sqrt((gradient**2).sum(axis=1)), 1e-300)[:, None]
        steps = [theta + s * newton for s in lengths]
        steps += [theta + s * gradient / norm for s in (0.05, 0.005)]
        raw = np.stack(steps)
        thetas, _ = project_first(raw, dims)
        asked = np.broadcast_to(active, thetas.shape[:2])
        watch.see(thetas, asked)
        found = rows.candidates(thetas, asked)
        found = np.where(np.isfinite(found), found, -np.inf)
        best = found.argmax(axis=0)
        at = np.arange(groups)
        new_ll, moved = found[best, at], thetas[best, at]
        better = active & (new_ll > ll)
        watch.corrected(raw[best, at], moved, better)
        gain = np.where(better, new_ll - ll, 0.0)
        shift = np.abs(moved - theta).max(axis=1)
        theta = np.where(better[:, None], moved, theta)
        ll = np.where(better, new_ll, ll)
        fallback |= better & (best >= len(lengths))
        damping = np.where(better, np.maximum(damping * 0.3, 1e-9), damping * 10.0)
        spent += active * (len(thetas) + 1)
        done = better & (
            (gain <= precision.f_tol * np.maximum(1.0, np.abs(ll)))
            | (shift <= precision.x_tol)
        )
        active &= ~done & (damping < 1e6) & (spent < budget)
    report = watch.report(theta)
    feasible = report["violation"] <= precision.constraint_tol
    return theta, {
        "initial": initial,
        "final": ll,
        "fallback": fallback,
        "attempted": voted,
        "accepted": voted & feasible & (ll >= initial),
        "snapped": snapped,
        **report,
    }


def actor_variances(rows, theta, order, dims: int, cfg: LineSearch):
    """Variance of intercept and slope and their covariance, per dimension."""
    voted = (rows.counts > 0) & np.isfinite(theta).all(axis=1)
    out = np.zeros((len(theta), dims, 3))
    linear = order >= 1
    for terms, pick in ((1, voted & ~linear), (2, voted & linear)):
        if not pick.any():
            continue
        at = theta if terms == 2 else theta[:, :dims]
        info = rows.derivatives(at, pick, information=True)[2]
        cov = bounded_inverse(info[:, : terms * dims, : terms * dims], cfg.eigen_floor)
        for k in range(dims):
            out[pick, k, 0] = cov[pick, k, k]
            if terms == 2:
                out[pick, k, 1] = cov[pick, dims + k, dims + k]
                out[pick, k, 2] = cov[pick, k, dims + k]
    return out
