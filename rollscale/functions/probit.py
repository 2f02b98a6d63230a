"""Normal CDF, its log and the Gaussian/CDF ratio.

Spark SQL has no error function, so the lower tail uses the published rational
approximation of Hart (1968) in the form given by West (2005); its relative
error is near machine precision on the clamped range.  The scaled tail
exp(z^2/2) * Phi(-z) is a ratio of two polynomials, which gives the log and the
Gaussian ratio without cancellation.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the rational approximation, highest power first.
TAIL_P = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
TAIL_Q = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)

# The table of the model runs from -5 to 5 in steps of 1e-4.
Z_MAX = 5.0
GRID = 10000.0


def _horner(x, coefficients):
    acc = coefficients[0] * x + coefficients[1]
    for c in coefficients[2:]:
        acc = acc * x + c
    return acc


def _horner_np(x: np.ndarray, coefficients) -> np.ndarray:
    acc = coefficients[0] * x
    acc += coefficients[1]
    for c in coefficients[2:]:
        acc *= x
        acc += c
    return acc


def _tail_ratio_np(a: np.ndarray) -> np.ndarray:
    out = _horner_np(a, TAIL_P)
    out /= _horner_np(a, TAIL_Q)
    return out


def _tail_ratio(a):
    return _horner(a, TAIL_P) / _horner(a, TAIL_Q)


def clamp(z: Column) -> Column:
    return F.greatest(F.lit(-Z_MAX), F.least(F.lit(Z_MAX), z))


def _log_phi_inside(z: Column) -> Column:
    a = F.abs(z)
    ratio = _tail_ratio(a)
    return F.when(z <= 0, -z * z / 2.0 + F.log(ratio)).otherwise(
        F.log(F.lit(1.0) - F.exp(-z * z / 2.0) * ratio)
    )


def log_phi(z: Column) -> Column:
    """log Phi(z), flat beyond the clamp."""
    return _log_phi_inside(clamp(z))


def _tail_ratio_sql(a: str) -> str:
    """The ratio as one SQL expression: a single call to the JVM builds it."""

    def nested(coefficients):
        text = f"{coefficients[0]!r}D"
        for c in coefficients[1:]:
            text = f"({text} * {a} + {c!r}D)"
        return text

    return f"({nested(TAIL_P)} / {nested(TAIL_Q)})"


_CLAMP = f"greatest({-Z_MAX}D, least({Z_MAX}D, {{z}})) as _z"
_RATIO = f"{_tail_ratio_sql('_a')} as _ratio"
_LOG = "if(_z <= 0, _half + ln(_ratio), ln(1D - exp(_half) * _ratio))"
_BELOW = "if(_z <= 0, exp(_half) * _ratio, 1D - exp(_half) * _ratio)"


def _staged(df: DataFrame, z: str) -> DataFrame:
    """Shared parts as columns, so that each is computed once per row.

    As one expression they would be repeated for every use and the generated code
    would grow past what the JVM compiles.
    """
    return (
        df.selectExpr("*", _CLAMP.format(z=z))
        .selectExpr("*", "abs(_z) as _a", "_z * _z / -2D as _half")
        .selectExpr("*", _RATIO)
    )


def with_log_phi(df: DataFrame, z: str, out: str = "ll") -> DataFrame:
    """`log_phi` of a column, in steps."""
    return _staged(df, z).selectExpr(*df.columns, f"{_LOG} as {out}")


def with_gauss_over_phi(df: DataFrame, z: str, out: str = "ratio") -> DataFrame:
    """`gauss_over_phi` of a column, in steps."""
    return _staged(df, z).selectExpr(
        *df.columns, f"exp({z} * {z} / -2D) / {_BELOW} as {out}"
    )


def phi(z: Column) -> Column:
    zc = clamp(z)
    tail = F.exp(-zc * zc / 2.0) * _tail_ratio(F.abs(zc))
    return F.when(zc <= 0, tail).otherwise(F.lit(1.0) - tail)


def pdf_over_phi(z: Column) -> Column:
    return gauss_over_phi(z) / float(np.sqrt(2.0 * np.pi))


def gauss_over_phi(z: Column) -> Column:
    """exp(-z^2/2) / Phi(z) with Phi taken at the clamped argument."""
    return F.exp(-z * z / 2.0) / phi(z)


def log_phi_linear(z: Column) -> Column:
    """Linear interpolation of the log column on the 1e-4 grid."""
    zc = clamp(z)
    low = F.least(F.floor(zc * GRID), F.lit(int(Z_MAX * GRID) - 1)).cast("double")
    share = zc * GRID - low
    at_low = _log_phi_inside(low / GRID)
    at_high = _log_phi_inside((low + 1.0) / GRID)
    return at_low + share * (at_high - at_low)


def log_phi_nearest(z: Column) -> Column:
    """Legacy rule: nearest grid point of |z|, capped two short of the end."""
    step = F.least(
        F.floor(F.abs(z) * GRID + 0.5).cast("double"), F.lit(Z_MAX * GRID - 2.0)
    )
    return _log_phi_inside(F.signum(z) * step / GRID)


def _exact_log_phi_np(z: np.ndarray) -> np.ndarray:
    ratio = _tail_ratio_np(np.abs(z))
    half = -0.5 * z * z
    return np.where(z <= 0, half + np.log(ratio), np.log1p(-np.exp(half) * ratio))


def exact_log_phi_np(z: np.ndarray) -> np.ndarray:
    """`log_phi` of an array."""
    return _exact_log_phi_np(np.clip(z, -Z_MAX, Z_MAX))


def log_phi_sum_np(low: np.ndarray, high: np.ndarray) -> float:
    """Sum of `log_phi` over arguments up to 0 and above 0."""
    low, high = np.minimum(-low, Z_MAX), np.minimum(high, Z_MAX)
    left = np.log(_tail_ratio_np(low)) - 0.5 * low * low
    right = np.log1p(-np.exp(-0.5 * high * high) * _tail_ratio_np(high))
    return float(left.sum() + right.sum())


@functools.lru_cache(maxsize=1)
def _log_table() -> tuple[np.ndarray, np.ndarray]:
    """log Phi on the 1e-4 grid and its forward differences."""
    points = int(2 * Z_MAX * GRID)
    values = _exact_log_phi_np((np.arange(points + 1) - Z_MAX * GRID) / GRID)
    return values, np.append(np.diff(values), 0.0)


def log_phi_np(z: np.ndarray) -> np.ndarray:
    """Linear interpolation on the grid, flat beyond the clamp."""
    values, slopes = _log_table()
    at = np.clip(z, -Z_MAX, Z_MAX)
    at += Z_MAX
    at *= GRID
    cell = at.astype(np.intp)  # as take wants them
    at -= cell
    at *= slopes.take(cell)
    at += values.take(cell)
    return at


#: Cells a unit of the single-precision table.
ROUGH_GRID = 512


@functools.lru_cache(maxsize=1)
def _rough_table() -> tuple[np.ndarray, np.ndarray]:
    """Lines through log Phi on a grid of 1 / ROUGH_GRID, as functions of ROUGH_GRID * z; flat outside."""
    at = np.arange(-int(Z_MAX * ROUGH_GRID), int(Z_MAX * ROUGH_GRID) + 1)
    values = _exact_log_phi_np(at / ROUGH_GRID)
    slopes = np.diff(values)
    base = np.r_[values[0], values[:-1] - slopes * at[:-1], values[-1]]
    return base.astype(np.float32), np.r_[0.0, slopes, 0.0].astype(np.float32)


def rough_log_phi_np(steps: np.ndarray) -> np.ndarray:
    """log Phi(steps / ROUGH_GRID) in single precision, within 5e-6 of the exact value."""
    base, slopes = _rough_table()
    cell = (steps + np.float32(Z_MAX * ROUGH_GRID + 1)).astype(np.intp)
    out = slopes.take(cell, mode="clip")
    out *= steps
    out += base.take(cell, mode="clip")
    return out


def gauss_over_phi_np(z: np.ndarray) -> np.ndarray:
    zc = np.clip(z, -Z_MAX, Z_MAX)
    tail = np.exp(-0.5 * zc * zc) * _tail_ratio_np(np.abs(zc))
    return np.exp(-0.5 * z * z) / np.where(zc <= 0, tail, 1.0 - tail)
