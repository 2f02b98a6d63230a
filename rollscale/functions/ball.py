"""Unit-ball and bound rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def radius(x1: Column, x2: Column) -> Column:
    return F.hypot(x1, x2)


def project_to_ball(x1: Column, x2: Column) -> tuple[Column, Column]:
    scale = F.greatest(F.lit(1.0), F.sqrt(x1 * x1 + x2 * x2))
    return x1 / scale, x2 / scale


def pull_inside(x1: Column, x2: Column, target: float = 0.75) -> tuple[Column, Column]:
    squared = x1 * x1 + x2 * x2
    factor = F.when(squared > 1.0, F.lit(target) / F.sqrt(squared)).otherwise(1.0)
    return x1 * factor, x2 * factor


def floor_spread(d: Column, smallest: float = 0.001, reset: float = 0.03) -> Column:
    return F.when(F.abs(d) <= smallest, F.lit(reset)).otherwise(d)


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def ball_contract(x1: Column, x2: Column, tolerance: float) -> dict[str, Column]:
    """Violation, feasibility and the value accepted (null when rejected)."""
    finite = _finite(x1) & _finite(x2)
    r = F.when(finite, F.sqrt(x1 * x1 + x2 * x2)).otherwise(float("inf"))
    violation = F.when(
        finite, F.greatest(F.lit(0.0), x1 * x1 + x2 * x2 - 1.0)
    ).otherwise(float("inf"))
    feasible = finite & (violation <= tolerance)
    snap = F.when(r > 1.0, r).otherwise(1.0)
    a1, a2 = x1 / snap, x2 / snap
    return {
        "raw_radius": r,
        "violation": violation,
        "feasible": feasible,
        "accepted1": F.when(feasible, a1),
        "accepted2": F.when(feasible, a2),
        "corrected": feasible & (r > 1.0),
        "correction": F.when(
            feasible & (r > 1.0), F.sqrt((x1 - a1) * (x1 - a1) + (x2 - a2) * (x2 - a2))
        ).otherwise(0.0),
    }


def bound_contract(
    x: Column, low: float, high: float, tolerance: float
) -> dict[str, Column]:
    if not low < high or tolerance < 0:
        raise ValueError("bounds must be ordered and the tolerance not negative")
    finite = _finite(x)
    violation = F.when(finite, F.greatest(F.lit(0.0), low - x, x - high)).otherwise(
        float("inf")
    )
    feasible = finite & (violation <= tolerance)
    accepted = F.greatest(F.lit(low), F.least(F.lit(high), x))
    return {
        "violation": violation,
        "feasible": feasible,
        "accepted": F.when(feasible, accepted),
        "correction": F.when(feasible, F.abs(x - accepted)).otherwise(0.0),
        "corrected": feasible & (F.abs(x - accepted) > 0),
    }


def bound_rule(x: float, low: float, high: float, tolerance: float) -> dict:
    """`bound_contract` of one number, as the searches at the driver use it."""
    if not low < high or tolerance < 0:
        raise ValueError("bounds must be ordered and the tolerance not negative")
    finite = math.isfinite(x)
    violation = max(0.0, low - x, x - high) if finite else math.inf
    feasible = finite and violation <= tolerance
    accepted = min(high, max(low, x)) if feasible else None
    correction = abs(x - accepted) if feasible else 0.0
    return {
        "violation": violation,
        "feasible": feasible,
        "accepted": accepted,
        "correction": correction,
        "corrected": correction > 0,
    }
