"""Output records that join evaluations before and after a phase."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Limits, Weights
from ..functions import probit
from . import scoring
from .audit import radial_deciles
from .partials import vectors_by_key
from .running import LIMITS
from .totals import with_totals


def classification_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """True classification percent before and after a phase."""
    last = scoring.log_likelihood(after).select(
        F.col("classification_pct").alias("after_pct"), "votes"
    )
    first = scoring.log_likelihood(before).select(
        F.col("classification_pct").alias("before_pct")
    )
    return with_totals(last, first)


def line_steps(rows: DataFrame, w: Weights, key: str, points: int, step: float = 0.01) -> DataFrame:
    """(key, step, gmp) of the points along a line search, one accumulator vector per group.

    rows: votes with x1, x2, the roll-call parameters and the rates u_x1, u_x2, u_d1, u_d2 at
    which a unit along the line moves position and spread.
    """
    (w1, w2) = w.squared()

    def part(batch, present, number):
        def column(name):
            return batch.column(name).to_numpy(zero_copy_only=False)

        sign = np.where(column("vote"), w.beta, -w.beta)
        gap = [column(f"x{k}") - column(f"z{k}") for k in (1, 2)]
        out = np.empty((len(present), points + 1))
        for i in range(points):
            yes = no = 0.0
            for k, weight in ((1, w1), (2, w2)):
                rest = gap[k - 1] - i * step * column(f"u_x{k}")
                spread = column(f"d{k}") - i * step * column(f"u_d{k}")
                yes, no = yes + weight * (rest + spread) ** 2, no + weight * (rest - spread) ** 2
            ll = probit.exact_log_phi_np(sign * (np.exp(-yes) - np.exp(-no)))
            out[:, i] = np.bincount(number, weights=ll, minlength=len(present))
        out[:, -1] = np.bincount(number, minlength=len(present))
        return out

    names = [f"{c}{k}" for c in ("x", "z", "d", "u_x", "u_d") for k in (1, 2)]
    found = vectors_by_key(rows.select(key, "vote", *names), key, part)
    count = F.element_at("vector", -1)
    tried = found.select(
        F.col("key").alias(key), count.alias("n"), F.posexplode(F.slice("vector", 1, points)).alias("step", "ll")
    )
    return tried.select(key, "step", F.exp(F.col("ll") / F.col("n")).alias("gmp"))


def path_gradients(terms: DataFrame, grid: DataFrame) -> DataFrame:
    """Member gradient sums expanded by the path basis."""
    rows = terms.join(
        grid.select("legislator_id", "period", "p1", "p2", "p3"), ["legislator_id", "period"]
    )
    aggs = [F.sum(f"gx{k}").alias(f"g0_{k}") for k in (1, 2)]
    aggs += [
        F.sum(F.col(f"gx{k}") * F.col(f"p{j}")).alias(f"g{j}_{k}")
        for j in (1, 2, 3)
        for k in (1, 2)
    ]
    return rows.groupBy("legislator_id").agg(*aggs, F.count("*").alias("votes"))


def rescue_points() -> np.ndarray:
    """The grid of step 0.1 strictly inside the disc, first coordinate first."""
    i, j = np.meshgrid(np.arange(-10, 11), np.arange(-10, 11), indexing="ij")
    inside = i * i + j * j < 100
    return np.stack([i[inside], j[inside]], axis=1) / 10.0


def rescue_grid(star: DataFrame, scored: DataFrame, w: Weights, floor: float = 0.5) -> DataFrame:
    """Best point of the grid for members whose fit is below the floor.

    A task adds its votes up to one vector over the grid points per member, so neither votes nor
    points multiply.  Equal likelihoods (to seven digits) go to the first grid point.
    """
    low = scoring.log_likelihood(scored, "legislator_id").where(F.col("gmp") < floor)
    rows = star.join(low.select("legislator_id"), "legislator_id", "left_semi")
    grid, (w1, w2) = rescue_points(), w.squared()

    def part(batch, present, number):
        z1, z2, d1, d2 = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("z1", "z2", "d1", "d2")
        )
        sign = np.where(batch.column("vote").to_numpy(zero_copy_only=False), w.beta, -w.beta)
        out = np.empty((len(present), len(grid) + 1))
        for k, (x1, x2) in enumerate(grid):
            yes = w1 * (x1 - z1 + d1) ** 2 + w2 * (x2 - z2 + d2) ** 2
            no = w1 * (x1 - z1 - d1) ** 2 + w2 * (x2 - z2 - d2) ** 2
            ll = probit.exact_log_phi_np(sign * (np.exp(-yes) - np.exp(-no)))
            out[:, k] = np.bincount(number, weights=ll, minlength=len(present))
        out[:, -1] = np.bincount(number, minlength=len(present))
        return out

    def best(member, vector):
        k = int(vector[:-1].round(7).argmax())
        return np.array([*grid[k], vector[k], vector[-1]])

    found = vectors_by_key(
        rows.select("legislator_id", "vote", "z1", "z2", "d1", "d2"), "legislator_id", part, finish=best
    )
    return found.select(
        F.col("key").alias("legislator_id"),
        *[
            F.col("vector")[i].alias(name)
            for i, name in enumerate(("grid1", "grid2", "log_likelihood"))
        ],
        F.col("vector")[3].cast("long").alias("votes"),
    )


def member_records(before: DataFrame, after: DataFrame) -> DataFrame:
    """Likelihood, errors and GMP per placement before and after a phase."""
    keys = ["legislator_id", "period"]

    def side(scored, name):
        s = scoring.log_likelihood(scored, *keys)
        return s.select(
            *keys,
            F.col("log_likelihood").alias(f"ll_{name}"),
            F.col("gross_errors").alias(f"errors_{name}"),
            F.col("gmp").alias(f"gmp_{name}"),
            F.col("votes").alias(f"votes_{name}"),
        )

    return (
        side(before, "before")
        .join(side(after, "after"), keys)
        .withColumnRenamed("votes_before", "votes")
    )


def member_output(records: DataFrame, state: DataFrame, variances: DataFrame) -> DataFrame:
    """Full output record of a placement: position, variance, error, fit statistics."""
    keys = ["legislator_id", "period"]
    return state.join(variances.select(*keys, "var1", "se1", "var2", "se2"), keys).join(
        records, keys
    )


def item_records(
    bills_before: DataFrame, bills_after: DataFrame, before: DataFrame, after: DataFrame
) -> DataFrame:
    """Roll-call diagnostics: counts, confusion, GMP and parameters before and after."""
    names = ("z1", "z2", "d1", "d2")

    def side(scored, name):
        s = scoring.log_likelihood(scored, "rollcall_id")
        counters = ("correct", "yea_correct", "yea_wrong", "nay_correct", "nay_wrong", "gmp")
        return s.select("rollcall_id", *[F.col(c).alias(f"{c}_{name}") for c in counters])

    def params(bills, name, extra=()):
        return bills.select("rollcall_id", *extra, *[F.col(c).alias(f"{c}_{name}") for c in names])

    return (
        params(bills_before, "before", ("yea", "nay"))
        .join(params(bills_after, "after"), "rollcall_id")
        .join(side(before, "before"), "rollcall_id")
        .join(side(after, "after"), "rollcall_id")
    )


def phase_state(
    scored: DataFrame, bills: DataFrame, w: Weights, limits: Limits = LIMITS
) -> DataFrame:
    """One row per phase: likelihood, classification, weights and radial deciles."""
    overall = scoring.log_likelihood(scored).select(
        "log_likelihood", "votes", "correct", "classification_pct"
    )
    return with_totals(overall, radial_deciles(bills, limits)).withColumns(
        {"w2": F.lit(w.w2), "beta": F.lit(w.beta)}
    )
