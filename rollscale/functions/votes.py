"""Recoding of raw cells, codes, parties and starts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of a missing cell.
NA_TOKENS = ("NA", "na", "N/A", "NaN", "nan", "")

# Party codes of the chamber records.
PARTY_LABELS = {100: "D", 200: "R"}

# Region group of state codes.
REGION_RANGE = (40, 49)
REGION_EXTRA = (51, 53, 54)

# Fixed values: (first period, last period, first party, second party).
PARTY_ERAS = (
    (1, 3, 4000, 5000),
    (4, 17, 200, 1),
    (19, 20, 555, 22),
    (21, 24, 555, 1275),
    (25, 30, 100, 29),
    (35, 999, 100, 200),
)

# Left-right score of party labels.
PARTY_SCORES = {
    "PRep": 1.0,
    "UDI": 0.9,
    "RN": 0.75,
    "EVOP": 0.6,
    "AMPL": 0.45,
    "PRI": 0.35,
    "IND": 0.0,
    "NOINFO": 0.0,
    "DC": -0.2,
    "PRad": -0.4,
    "PL": -0.45,
    "FRVS": -0.5,
    "PPD": -0.55,
    "PS": -0.6,
    "IC": -0.7,
    "PEV": -0.7,
    "RD": -0.8,
    "PH": -0.8,
    "PC": -0.9,
    "CS": -0.9,
    "COM": -0.9,
}


def unquote(cell: Column) -> Column:
    return F.regexp_replace(F.trim(cell), '^"|"$', "")


def null_if_na(cell: Column) -> Column:
    text = F.trim(cell)
    return F.when(text.isin(*NA_TOKENS), F.lit(None)).otherwise(text)


def parse_int(cell: Column, default: int | None = None) -> Column:
    """The integer that the cell begins with: 6 for "6.0", 1 for "1x"."""
    value = F.regexp_extract(null_if_na(cell), r"^([+-]?[0-9]+)", 1).try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def parse_double(cell: Column, default: float | None = None) -> Column:
    value = null_if_na(cell).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(default))


def vote_of(code: Column) -> Column:
    """1-3 yea, 4-6 nay, everything else missing (null)."""
    return F.when(code.between(1, 3), True).when(code.between(4, 6), False)


def is_observed_cell(cell: Column) -> Column:
    """A free-form cell holds a vote when it reads as a number from 1 to 6."""
    return F.coalesce(F.trim(cell).try_cast("double").between(1.0, 6.0), F.lit(False))


def is_present_code(code: Column) -> Column:
    """Looser test used for the roster: neither unknown (-1) nor out of the body (9)."""
    return code.isNotNull() & ~code.isin(-1, 9)


def party_label(code: Column, independent: int | None = None) -> Column:
    label = F.lit("I") if independent is None else F.when(code == independent, "I")
    for value, text in reversed(PARTY_LABELS.items()):
        label = F.when(code == value, text).otherwise(label)
    return label


def in_region(state: Column) -> Column:
    return state.between(*REGION_RANGE) | state.isin(*REGION_EXTRA)


def round_start(x: Column) -> Column:
    """Three decimals, halves to even; NaN and null pass through."""
    return F.when(F.isnan(x), x).otherwise(F.rint(x * 1000.0) / 1000.0)


#: The minimal standard generator (multiplier, prime modulus).
MULTIPLIER, MODULUS = 48271, 2147483647


def _uniform(key: Column, seed: int, stream: int) -> Column:
    """A number in (0, 1) that depends on key, seed and stream only."""
    state = F.pmod(key * 69621 + (seed * 7919 + stream * 104729), F.lit(MODULUS - 1)) + 1
    for _ in range(3):
        state = (state * MULTIPLIER) % MODULUS
    return state / F.lit(float(MODULUS))


def perturbed_start(
    x: Column, key: Column, seed: int, sd: float = 0.30, edge: float = 0.99
) -> Column:
    """x with normal noise, clamped to the square; the noise belongs to the key, so it is the same
    however the rows are partitioned."""
    key = F.pmod(key.cast("bigint"), F.lit(MODULUS))
    far = F.sqrt(F.lit(-2.0) * F.log(_uniform(key, seed, 1)))
    noise = far * F.cos(F.lit(2.0 * math.pi) * _uniform(key, seed, 2))
    return F.greatest(F.lit(-edge), F.least(F.lit(edge), x + noise * sd))


def perturbed_seeds(seeds: DataFrame, seed: int, sd: float = 0.30) -> DataFrame:
    """A table of starts (legislator_id, x1, x2) with noise on both dimensions; missing values
    stay missing."""
    key = F.col("legislator_id")
    return seeds.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), perturbed_start(F.col(c), key, seed + k, sd))
            for k, c in enumerate(("x1", "x2"))
        }
    )
