"""Vectorised helpers used inside tasks: many groups of votes stepped together.

A task holds the rows of several roll calls (or members) sorted by group.  The
solvers in `rollscale.plans` only ask for log-likelihoods and gradients per group, so
the same solver also runs when a Spark aggregate supplies those sums.
"""

from __future__ import annotations

import numpy as np

from ..config import Weights
from .probit import ROUGH_GRID, gauss_over_phi_np, log_phi_np, rough_log_phi_np


class Runs:
    """Rows sorted by group: sums over the groups, and values of a group at its rows."""

    def __init__(self, number: np.ndarray, groups: int):
        self.groups = groups
        self.starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else []
        self.present = number[self.starts] if len(number) else []
        self.sizes = np.diff(np.append(self.starts, len(number)))

    def sum(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.groups)
        if len(self.starts):
            out[self.present] = np.add.reduceat(values, self.starts)
        return out

    def sum_rough(self, values: np.ndarray) -> np.ndarray:
        """Sums of single-precision values, added up in double precision."""
        out = np.zeros(self.groups)
        if len(self.starts):
            out[self.present] = np.add.reduceat(values, self.starts, dtype=np.float64)
        return out

    def at(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values[self.present], self.sizes) if len(self.starts) else np.zeros(0)


def utilities(x, z, d, sign, w: Weights):
    """Distances, exponentiated utilities and zs for rows of dims columns."""
    w2 = w.squared()
    u_yes = 0.0
    u_no = 0.0
    yes, no = [], []
    for k in range(w.dims):
        a = x[k] - z[k] + d[k]
        b = x[k] - z[k] - d[k]
        u_yes = u_yes - w2[k] * a * a
        u_no = u_no - w2[k] * b * b
        yes.append(a)
        no.append(b)
    e_yes, e_no = np.exp(u_yes), np.exp(u_no)
    return yes, no, e_yes, e_no, sign * (w.beta * (e_yes - e_no))


def signed_gap(rest, spread, sign, w: Weights) -> np.ndarray:
    """zs from the distance to the midpoint (rest) and the spread, per dimension.

    With A = sum w2 (rest^2 + spread^2) and B = 2 sum w2 rest spread the two
    exponentiated utilities are exp(-A - B) and exp(-A + B), and A >= |B|.
    """
    near = 0.0
    tilt = 0.0
    for r, d, w2 in zip(rest, spread, w.squared()):
        near = near + w2 * (r * r + d * d)
        tilt = tilt + (2.0 * w2) * (r * d)
    gap = np.exp(-(near + tilt))
    gap -= np.exp(tilt - near)
    gap *= sign
    return gap


def path_basis(t: np.ndarray) -> np.ndarray:
    """Legendre terms 0 to 3 of local times, a column each."""
    basis = np.ones((len(t), 4))
    basis[:, 1], basis[:, 2], basis[:, 3] = t, (3 * t**2 - 1) / 2, (5 * t**3 - 3 * t) / 2
    return basis


def _by_group(number: np.ndarray):
    """Sorted group numbers, and the rows in that order."""
    order = np.argsort(number, kind="stable")
    return number[order], order


class _Screened:
    """Best candidates on a line, the hopeless ones being ruled out in single precision."""

    def leading(self, thetas, valid):
        """`candidates` as far as the best ones need it: -inf for those that are surely worse.

        Every candidate is evaluated in single precision first; the ones within its error of the
        best, and the ones off the line, are then evaluated as they stand.
        """
        if len(thetas) < 3:
            return self.candidates(thetas, valid)
        even = thetas[0] + np.arange(len(thetas))[:, None, None] * (thetas[1] - thetas[0])
        on_line = valid & (np.abs(thetas - even).max(axis=2) <= 1e-12)
        rough = self._rough(thetas, on_line)
        if rough is None:
            return self.candidates(thetas, valid)
        # Per vote: two exponentials and a product of them off by 8e-7 beta, at a slope of up to 5.2.
        error = (5e-6 * self.w.beta + 5e-6) * self.counts
        broken = (on_line & ~np.isfinite(rough)).any(axis=0)
        left = valid & (broken | ~on_line | (rough >= rough.max(axis=0) - 2.0 * error))
        out = np.full(valid.shape, -np.inf)
        groups = np.arange(valid.shape[1])
        while left.any():
            pick = left.argmax(axis=0)
            here = left[pick, groups]
            rows, runs = self._rows(here)
            ll = runs.sum(self._direct(thetas[pick, groups], rows, runs))
            out[pick[here], groups[here]] = ll[here]
            left[pick[here], groups[here]] = False
        return out

    def _rough(self, thetas, asked):
        """Likelihoods along the line in single precision; None if midpoint and spread both move.

        With the squared distances a + b c + g c^2 of candidate c from the yes and the no point,
        zs is sign beta (exp(-yes) - exp(-no)).
        """
        out = np.full(asked.shape, -np.inf)
        if not asked.any():
            return out
        rows, runs = self._rows(asked.any(axis=0))
        parts = self._line(thetas, rows, runs)
        if parts is None:
            return None
        rest, spread, rest_moves, spread_moves = parts
        yes, no, yes1, no1, bend = 0.0, 0.0, 0.0, 0.0, 0.0
        for r, d, mr, md, w2 in zip(rest, spread, rest_moves, spread_moves, self.w.squared()):
            a, b = r + d, r - d
            yes, no = yes - w2 * a * a, no - w2 * b * b
            yes1, no1 = yes1 - 2.0 * w2 * a * (mr + md), no1 - 2.0 * w2 * b * (mr - md)
            bend = bend - w2 * (mr + md) ** 2
        yes, no, yes1, no1, bend = (v.astype(np.float32) for v in (yes, no, yes1, no1, bend))
        scale = (self.sign[rows] * (self.w.beta * ROUGH_GRID)).astype(np.float32)
        curve, gap, other = np.empty_like(yes), np.empty_like(yes), np.empty_like(yes)
        for c in range(len(thetas)):
            if not asked[c].any():
                continue
            step = np.float32(c)
            np.multiply(bend, step, out=curve)
            for u, u1, e in ((yes, yes1, gap), (no, no1, other)):
                np.add(curve, u1, out=e)
                e *= step
                e += u
                np.exp(e, out=e)
            gap -= other
            gap *= scale
            out[c] = np.where(asked[c], runs.sum_rough(rough_log_phi_np(gap)), -np.inf)
        return out


class ItemRows(_Screened):
    """Votes of a block of roll calls; parameters vary by group."""

    def __init__(self, number, x, vote, groups: int, w: Weights):
        self.w = w
        self.groups = groups
        self.number, order = _by_group(number)
        self.x = [x[order, k] for k in range(w.dims)]
        self.sign = np.where(vote[order], 1.0, -1.0)
        self.counts = np.bincount(number, minlength=groups)
        self.runs = Runs(self.number, groups)

    def _rows(self, active):
        if active.all():
            return slice(None), self.runs
        rows = np.flatnonzero(active[self.number])
        return rows, Runs(self.number[rows], self.groups)

    def candidates(self, thetas, valid):
        """thetas: candidates x groups x params -> candidates x groups.

        Equally spaced candidates that move only the spread or only the midpoint are
        stepped by multiplication; any other candidate is evaluated on its own.
        """
        out = np.full(valid.shape, -np.inf)
        asked = valid.any(axis=0)
        if not asked.any():
            return out
        stepped = np.zeros(valid.shape, dtype=bool)
        if len(thetas) > 2:
            even = thetas[0] + np.arange(len(thetas))[:, None, None] * (thetas[1] - thetas[0])
            stepped = valid & (np.abs(thetas - even).max(axis=2) <= 1e-12)
            moves = ((thetas[1] - thetas[0]) != 0).any(axis=0)
            mid, spread = moves[: self.w.dims].any(), moves[self.w.dims :].any()
            if mid == spread or not self._step(thetas, stepped, asked, spread, out):
                stepped[:] = False
        for c in range(len(thetas)):
            alone = valid[c] & ~stepped[c]
            if alone.any():
                rows, runs = self._rows(alone)
                ll = runs.sum(self._direct(thetas[c], rows, runs))
                out[c] = np.where(alone, ll, out[c])
        return out

    def _parts(self, theta, rows, runs):
        dims = self.w.dims
        rest = [self.x[k][rows] - runs.at(theta[:, k]) for k in range(dims)]
        spread = [runs.at(theta[:, dims + k]) for k in range(dims)]
        return rest, spread

    def _line(self, thetas, rows, runs):
        """Distance to the midpoint and spread at the first candidate, and their moves per step."""
        dims = self.w.dims
        delta = thetas[1] - thetas[0]
        mid, spread_moves = delta[:, :dims].any(), delta[:, dims:].any()
        if mid and spread_moves:
            return None
        rest, spread = self._parts(thetas[0], rows, runs)
        moves = [runs.at(delta[:, k]) for k in range(2 * dims)]
        return rest, spread, [-m for m in moves[:dims]], moves[dims:]

    def _direct(self, theta, rows, runs):
        rest, spread = self._parts(theta, rows, runs)
        return log_phi_np(signed_gap(rest, spread, self.sign[rows] * self.w.beta, self.w))

    def _step(self, thetas, stepped, asked, spread_moves, out) -> bool:
        """Fill `out` along the line; False when the exponents could overflow.

        zs = sign beta exp(-A) (exp(-B) - exp(B)).  Per candidate, a move of the spread
        multiplies exp(B) by a factor per row and exp(-A) by one per group; a move of
        the midpoint does it the other way round.
        """
        w, dims = self.w, self.w.dims
        rows, runs = self._rows(asked)
        rest, spread = self._parts(thetas[0], rows, runs)
        delta = thetas[1] - thetas[0]
        moved = slice(dims, 2 * dims) if spread_moves else slice(0, dims)
        shift = [runs.at(delta[:, moved][:, k]) for k in range(dims)]
        w2 = w.squared()
        tilt = sum(2.0 * w2[k] * rest[k] * spread[k] for k in range(dims))
        if spread_moves:
            near = sum(w2[k] * rest[k] ** 2 for k in range(dims))
            turn = sum(2.0 * w2[k] * rest[k] * shift[k] for k in range(dims))
        else:
            near = sum(w2[k] * (rest[k] ** 2 + spread[k] ** 2) for k in range(dims))
            turn = sum(2.0 * w2[k] * rest[k] * shift[k] for k in range(dims))
        if np.abs(tilt).max() + len(thetas) * np.abs(turn).max() > 300.0:
            return False
        base = np.exp(-near) * (self.sign[rows] * w.beta)
        lift, factor = np.exp(tilt), np.exp(turn)
        weights = np.array(w2[:dims])
        for c in range(len(thetas)):
            if c:
                if spread_moves:
                    lift *= factor
                else:
                    base *= factor
            if not stepped[c].any():
                continue
            if spread_moves:
                level = np.exp(-(weights * thetas[c][:, moved] ** 2).sum(axis=1))
                gap = 1.0 / lift
                gap -= lift
            else:
                level = np.exp(-(c * c) * (weights * delta[:, moved] ** 2).sum(axis=1))
                slide = runs.at(
                    np.exp(-2.0 * c * (weights * delta[:, moved] * thetas[0][:, dims:]).sum(axis=1))
                )
                slide *= lift
                gap = 1.0 / slide
                gap -= slide
            gap *= base
            gap *= runs.at(level)
            ll = runs.sum(log_phi_np(gap))
            out[c] = np.where(stepped[c], ll, out[c])
        return True

    def derivatives(self, theta, active, information=False):
        """Log-likelihood, unnormalised gradient terms and their outer products."""
        w, (rows, runs) = self.w, self._rows(active)
        x = [c[rows] for c in self.x]
        z = [runs.at(theta[:, k]) for k in range(w.dims)]
        d = [runs.at(theta[:, w.dims + k]) for k in range(w.dims)]
        sign = self.sign[rows]
        yes, no, e_yes, e_no, zs = utilities(x, z, d, sign, w)
        ratio = sign * gauss_over_phi_np(zs)
        terms = []
        for part in (lambda a, b: b - a, lambda a, b: a + b):
            for k, w2 in zip(range(w.dims), w.squared()):
                terms.append(ratio * w2 * part(yes[k] * e_yes, no[k] * e_no))
        return _totals(log_phi_np(zs), terms, runs, information)


class ActorRows(_Screened):
    """Votes of a block of members; parameters are path coefficients by group."""

    def __init__(self, number, basis, z, d, vote, groups: int, w: Weights):
        self.w = w
        self.groups = groups
        self.number, order = _by_group(number)
        self.basis = np.asfortranarray(basis[order])
        self.z = [z[order, k] for k in range(w.dims)]
        self.d = [d[order, k] for k in range(w.dims)]
        self.sign = np.where(vote[order], 1.0, -1.0)
        self.counts = np.bincount(number, minlength=groups)
        self.runs = Runs(self.number, groups)

    _rows = ItemRows._rows

    def candidates(self, thetas, valid):
        """As for roll calls; only the path terms that move are added again."""
        out = np.full(valid.shape, -np.inf)
        asked = valid.any(axis=0)
        if not asked.any():
            return out
        w, dims = self.w, self.w.dims
        rows, runs = self._rows(asked)
        sign = self.sign[rows] * w.beta
        spread = [c[rows] for c in self.d]
        # Where the candidates move from the first one, by path term.
        start = self._positions(thetas[0], rows, runs)
        rest = [start[k] - self.z[k][rows] for k in range(dims)]
        moved = [
            j for j in range(thetas.shape[2] // dims)
            if (thetas[:, :, j * dims : (j + 1) * dims] != thetas[0, :, j * dims : (j + 1) * dims]).any()
        ]
        basis = {j: None if j == 0 else self.basis[rows, j] for j in moved}
        for c in range(len(thetas)):
            shift = thetas[c] - thetas[0]
            here = list(rest)
            for j in moved:
                for k in range(dims):
                    step = runs.at(shift[:, j * dims + k])
                    here[k] = here[k] + (step if j == 0 else step * basis[j])
            ll = runs.sum(log_phi_np(signed_gap(here, spread, sign, w)))
            out[c] = np.where(valid[c], ll, -np.inf)
        return out

    def _line(self, thetas, rows, runs):
        """As for roll calls; the spreads stay."""
        rest, spread = self._parts(thetas[0], rows, runs)
        return rest, spread, self._positions(thetas[1] - thetas[0], rows, runs), [0.0] * self.w.dims

    def _parts(self, theta, rows, runs):
        x = self._positions(theta, rows, runs)
        return [x[k] - self.z[k][rows] for k in range(self.w.dims)], [d[rows] for d in self.d]

    _direct = ItemRows._direct

    def _positions(self, theta, rows, runs):
        terms = theta.shape[1] // self.w.dims
        x = []
        for k in range(self.w.dims):
            acc = runs.at(theta[:, k])
            for j in range(1, terms):
                acc = acc + runs.at(theta[:, j * self.w.dims + k]) * self.basis[rows, j]
            x.append(acc)
        return x

    def derivatives(self, theta, active, information=False):
        w, (rows, runs) = self.w, self._rows(active)
        x = self._positions(theta, rows, runs)
        z = [c[rows] for c in self.z]
        d = [c[rows] for c in self.d]
        sign = self.sign[rows]
        yes, no, e_yes, e_no, zs = utilities(x, z, d, sign, w)
        ratio = sign * gauss_over_phi_np(zs)
        base = [
            ratio * w2 * (yes[k] * e_yes - no[k] * e_no)
            for k, w2 in zip(range(w.dims), w.squared())
        ]
        terms = [
            base[k] if j == 0 else base[k] * self.basis[rows, j]
            for j in range(theta.shape[1] // w.dims)
            for k in range(w.dims)
        ]
        return _totals(log_phi_np(zs), terms, runs, information)


def _totals(ll, terms, runs, information):
    gradient = np.stack([runs.sum(t) for t in terms], axis=1)
    info = None
    if information:
        p = len(terms)
        info = np.zeros((runs.groups, p, p))
        for i in range(p):
            for j in range(i, p):
                info[:, i, j] = info[:, j, i] = runs.sum(terms[i] * terms[j])
    return runs.sum(ll), gradient, info


def project_first(theta: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Pull the first `dims` parameters onto the ball where they left it."""
    norm = np.sqrt((theta[..., :dims] ** 2).sum(axis=-1))
    outside = norm > 1.0
    out = theta.copy()
    out[..., :dims] /= np.where(outside, norm, 1.0)[..., None]
    return out, outside


def bounded_inverse(info: np.ndarray, floor: float) -> np.ndarray:
    """Inverse of symmetric matrices over the eigenvalues above the floor."""
    values, vectors = np.linalg.eigh(info)
    keep = np.abs(values) > floor
    inverse = np.where(keep, 1.0 / np.where(keep, values, 1.0), 0.0)
    return np.einsum("gik,gk,gjk->gij", vectors, inverse, vectors)
