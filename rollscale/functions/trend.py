"""Local time, polynomial basis and the order a tenure allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Served periods needed for a linear, quadratic and cubic path.
ORDER_TENURE = ((7, 3), (6, 2), (5, 1))


def local_time(k: Column, served: Column) -> Column:
    """k-th of `served` periods (1-based) on an even grid from -1 to 1."""
    return F.when(
        served > 1, (k - 1).cast("double") * (F.lit(2.0) / (served - 1)) - 1.0
    ).otherwise(F.lit(-1.0))


def calendar_time(period: Column, last_period: Column) -> Column:
    return F.when(
        last_period > 1, (period - 1).cast("double") * 2.0 / (last_period - 1) - 1.0
    ).otherwise(F.lit(0.0))


def legendre(t: Column) -> tuple[Column, Column, Column, Column]:
    return (
        F.lit(1.0),
        t,
        (t * t * 3.0 - 1.0) / 2.0,
        (t * t * t * 5.0 - t * 3.0) / 2.0,
    )


def effective_order(served: Column, model: int) -> Column:
    allowed = F.lit(0)
    for tenure, order in reversed(ORDER_TENURE):
        allowed = F.when(served >= tenure, order).otherwise(allowed)
    return F.least(F.lit(model), allowed)
