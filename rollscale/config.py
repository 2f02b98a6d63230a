"""Settings shared by the operators and the fitting plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Weights:
    """Salience of the two dimensions and the signal-to-noise scale."""

    w1: float = 1.0
    w2: float = 0.5
    beta: float = 6.0
    dims: int = 2

    def squared(self) -> tuple[float, float]:
        return self.w1 * self.w1, (self.w2 * self.w2 if self.dims > 1 else 0.0)

    def with_value(self, name: str, value: float) -> "Weights":
        return replace(self, **{name: value})


@dataclass(frozen=True)
class Limits:
    """Sizes that decide between two exact ways of doing the same work.

    broadcast_rows: a table is only broadcast when its counted rows stay below this.
    group_rows: groups above this never enter a single task; the same kernels sum
        their votes where they are, a job per solver step.
    block_rows: most rows a grouped numpy block should hold on average.
    least_block_rows: blocks are not cut smaller than this to feed idle cores.
    scan_rows: rows of a partition of cached cells.
    hot_batch: most oversized groups that are stepped together from the driver.
    leaf_rows: points of an oversized roll call that are sorted together.
    slice_rows: votes of an oversized group that lie together in a partition.
    """

    broadcast_rows: int = 1_000_000
    group_rows: int = 1_000_000
    block_rows: int = 40_000
    least_block_rows: int = 2_000
    hot_batch: int = 100_000
    leaf_rows: int = 4_096
    slice_rows: int = 100_000
    scan_rows: int = 400_000


@dataclass(frozen=True)
class LineSearch:
    """Constants of the line-search block fits (fixed values of the model)."""

    outer_cycles: int = 5
    inner_steps: int = 10
    points: int = 25
    temporal_points: int = 10
    step: float = 0.01
    gain_tol: float = 1e-4
    gmp_drop: float = 1e-5
    min_spread: float = 0.001
    reset_spread: float = 0.03
    zero_gradient: float = 1e-4
    interior: float = 0.75
    rescue_gmp: float = 0.5
    eigen_floor: float = 1e-4


# Precision profiles (relative x tolerance, relative f tolerance,
# constraint tolerance, evaluation budgets for scalars, items and actors).
PRECISION = {
    "relaxed": (1e-5, 1e-7, 1e-8, 60, 150, 250),
    "standard": (1e-8, 1e-10, 1e-10, 120, 400, 600),
    "strict": (1e-10, 1e-12, 1e-12, 360, 1200, 1800),
    "ultra": (1e-12, 1e-14, 1e-13, 720, 2400, 3600),
}


@dataclass(frozen=True)
class Precision:
    """Tolerances and budgets of the constrained block fits in one cycle."""

    x_tol: float
    f_tol: float
    constraint_tol: float
    scalar_evals: int
    item_evals: int
    actor_evals: int

    @staticmethod
    def profile(name: str = "standard") -> "Precision":
        if name not in PRECISION:
            raise ValueError(f"unknown precision profile: {name}")
        return Precision(*PRECISION[name])

    def for_cycle(self, cycle: int, first: int, last: int, adaptive: bool) -> "Precision":
        """Looser tolerances and smaller budgets before the last cycle."""
        if not adaptive or cycle >= last:
            return self
        early = cycle <= first + (last - first) // 2
        share = 0.25 if early else 0.5

        def budget(floor: int, full: int) -> int:
            return max(floor, -int(-(full * share) // 1))

        return Precision(
            max(self.x_tol, 1e-4 if early else 1e-6),
            max(self.f_tol, 1e-6 if early else 1e-8),
            max(self.constraint_tol, 1e-7 if early else 1e-9),
            budget(20, self.scalar_evals),
            budget(30, self.item_evals),
            budget(40, self.actor_evals),
        )


@dataclass(frozen=True)
class FitConfig:
    """How a fit runs: cycles, model order, solver and stopping rule."""

    cycles: int = 4
    order: int = 1
    margin: float = 0.025
    solver: str = "line"  # "line" or "constrained"
    scalar_scope: str = "local"  # "local" or "global" box of the bounded scalar fit
    precision: str = "standard"
    adaptive: bool = False
    abs_tol: float = 0.0
    rel_tol: float = 0.0
    min_cycles: int = 2
    patience: int = 2
    fix_globals: bool = False
    fix_items: bool = False
    fix_actors: bool = False
    cut_starts: bool = True
    first_period: int | None = None
    last_period: int | None = None
    line: LineSearch = field(default_factory=LineSearch)
    limits: Limits = field(default_factory=Limits)
