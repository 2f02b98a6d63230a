"""Spatial utility, probit argument and derivative terms as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..config import Weights
from . import probit

# Gradient of the log-likelihood = GRAD_SCALE * beta * (unnormalised term).
GRAD_SCALE = -2.0 / float(np.sqrt(2.0 * np.pi))


def with_distances(df: DataFrame) -> DataFrame:
    """yes1, no1, yes2, no2: signed distance to the Yes and No point per dimension."""
    return df.selectExpr(
        "*",
        *[
            text
            for k in (1, 2)
            for text in (f"x{k} - z{k} + d{k} as yes{k}", f"x{k} - z{k} - d{k} as no{k}")
        ],
    )


def with_utilities(df: DataFrame, w: Weights) -> DataFrame:
    w1, w2 = w.squared()

    def utility(side: str) -> str:
        return f"-({side}1 * {side}1 * {w1!r}D + {side}2 * {side}2 * {w2!r}D)"

    yes, no = utility("yes"), utility("no")
    return df.selectExpr(
        "*", f"if(vote, {yes}, {no}) as u_chosen", f"if(vote, {no}, {yes}) as u_other"
    )


def with_scores(df: DataFrame, w: Weights) -> DataFrame:
    """zs, log-likelihood contribution and the classification flags."""
    df = df.selectExpr("*", "exp(u_chosen) as e_chosen", "exp(u_other) as e_other")
    df = df.selectExpr("*", f"(e_chosen - e_other) * {w.beta!r}D as zs")
    return probit.with_log_phi(df, "zs", "ll").selectExpr(
        "*",
        "abs(u_chosen) <= abs(u_other) as correct",
        "zs < 0 as gross_error",
        "zs > 0 as positive",
    )


def scored(df: DataFrame, w: Weights) -> DataFrame:
    return with_scores(with_utilities(with_distances(df), w), w)


def with_derivatives(df: DataFrame, w: Weights) -> DataFrame:
    """Unnormalised terms per vote: gx (actor), gz (midpoint), gd (spread).

    The true gradient is GRAD_SCALE * beta times each term; the midpoint term is
    the actor term with the opposite sign.
    """
    names = df.columns
    df = probit.with_gauss_over_phi(df, "zs", "ratio").selectExpr(
        "*",
        "if(vote, ratio, -ratio) as _pull",
        "if(vote, e_chosen, e_other) as _yes",
        "if(vote, e_other, e_chosen) as _no",
    )
    terms = []
    for k, w2 in zip((1, 2), w.squared()):
        a, b = f"yes{k} * _yes", f"no{k} * _no"
        terms += [
            f"_pull * ({a} - {b}) * {w2!r}D as gx{k}",
            f"_pull * ({b} - {a}) * {w2!r}D as gz{k}",
            f"_pull * ({a} + {b}) * {w2!r}D as gd{k}",
        ]
    return df.selectExpr(*names, "ratio", *terms)
