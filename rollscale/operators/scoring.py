"""Star join, likelihood, classification and cross-tab aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Weights
from ..functions import spatial
from ..functions.votes import in_region


def star_join(votes: DataFrame, state: DataFrame, bills: DataFrame) -> DataFrame:
    """Real votes x member positions x parameters of usable roll calls.

    The parameter tables carry no hint here: the caller marks them for broadcast
    after counting them, otherwise AQE measures the shuffled size and splits
    skewed keys.
    """
    params = bills.where("valid").select("rollcall_id", "z1", "z2", "d1", "d2")
    return (
        votes.select("legislator_id", "period", "rollcall_id", "vote")
        .join(params, "rollcall_id")
        .join(state.select("legislator_id", "period", "x1", "x2"), ["legislator_id", "period"])
    )


def score(star: DataFrame, w: Weights) -> DataFrame:
    return spatial.scored(star, w)


def log_likelihood(scored: DataFrame, *by: str) -> DataFrame:
    """Log-likelihood, counts and confusion; overall or per group."""
    correct, vote = F.col("correct"), F.col("vote")
    out = scored.groupBy(*by).agg(
        F.sum("ll").alias("log_likelihood"),
        F.count("*").alias("votes"),
        F.count_if(correct).alias("correct"),
        F.count_if(vote & correct).alias("yea_correct"),
        F.count_if(vote & ~correct).alias("yea_wrong"),
        F.count_if(~vote & correct).alias("nay_correct"),
        F.count_if(~vote & ~correct).alias("nay_wrong"),
        F.count_if("gross_error").alias("gross_errors"),
        F.count_if("positive").alias("positive"),
    )
    return out.withColumns(
        {
            "gmp": F.exp(F.col("log_likelihood") / F.col("votes")),
            "classification_pct": F.col("correct") * 100.0 / F.col("votes"),
        }
    )


def stored_class_pct(fit: DataFrame) -> DataFrame:
    """Classification percent from the four confusion columns of a stored fit."""
    right = F.sum(F.col("yea_correct") + F.col("nay_correct"))
    wrong = F.sum(F.col("yea_wrong") + F.col("nay_wrong"))
    return fit.agg(F.round(right * 100.0 / (right + wrong), 3).alias("classification_pct"))


def apre(scored: DataFrame, bills: DataFrame) -> DataFrame:
    """Aggregate proportional reduction in error over usable roll calls."""
    errors = scored.groupBy("rollcall_id").agg(
        F.count_if(~F.col("correct")).alias("errors")
    )
    kept = bills.where("valid").select(
        "rollcall_id", F.least("yea", "nay").alias("minority")
    )
    joined = kept.join(errors, "rollcall_id", "left").fillna({"errors": 0})
    return joined.agg(
        F.sum("minority").alias("minority"),
        F.sum("errors").alias("errors"),
        ((F.sum("minority") - F.sum("errors")) / F.sum("minority")).alias("apre"),
    )


def party_crosstab(votes: DataFrame, roster: DataFrame, parties: tuple[int, int]) -> DataFrame:
    """Per roll call: yes/no by first/second party and region group, plus missing."""
    side = votes.join(
        roster.select("legislator_id", "party", in_region(F.col("state")).alias("region")),
        "legislator_id",
        "left",
    )
    aggs = []
    for vote_name, is_vote in (("yea", F.col("vote")), ("nay", ~F.col("vote"))):
        aggs.append(F.count_if(is_vote).alias(vote_name))
        for p_name, party in (("p1", parties[0]), ("p2", parties[1])):
            of_party = is_vote & (F.col("party") == party)
            aggs.append(F.count_if(of_party).alias(f"{vote_name}_{p_name}"))
            aggs.append(
                F.count_if(of_party & F.col("region")).alias(f"{vote_name}_{p_name}_in")
            )
            aggs.append(
                F.count_if(of_party & ~F.col("region")).alias(f"{vote_name}_{p_name}_out")
            )
    aggs.append(F.count_if(F.col("vote").isNull()).alias("missing"))
    return side.groupBy("rollcall_id").agg(*aggs)


def party_region_rollup(votes: DataFrame, roster: DataFrame) -> DataFrame:
    side = votes.where(F.col("vote").isNotNull()).join(
        roster.select(
            "legislator_id", "party", in_region(F.col("state")).cast("int").alias("region")
        ),
        "legislator_id",
    )
    return side.rollup("party", "region").agg(
        F.count_if("vote").alias("yea"), F.count_if(~F.col("vote")).alias("nay")
    )


def gradients(scored_with_terms: DataFrame, by: str, terms: tuple[str, ...]) -> DataFrame:
    return scored_with_terms.groupBy(by).agg(
        *[F.sum(t).alias(t) for t in terms], F.count("*").alias("votes")
    )


def information(scored_with_terms: DataFrame, by: str = "legislator_id") -> DataFrame:
    """Sums of outer products of the member derivative terms (three unique cells)."""
    g1, g2 = F.col("gx1"), F.col("gx2")
    return scored_with_terms.groupBy(by).agg(
        F.sum(g1 * g1).alias("i11"),
        F.sum(g1 * g2).alias("i12"),
        F.sum(g2 * g2).alias("i22"),
        F.count("*").alias("votes"),
    )


def covariance_2x2(info: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Inverse over the eigenvalues above the floor, in closed form."""
    half = (F.col("i11") + F.col("i22")) / 2.0
    gap = F.sqrt(
        (F.col("i11") - F.col("i22")) * (F.col("i11") - F.col("i22")) / 4.0
        + F.col("i12") * F.col("i12")
    )
    df = info.withColumns({"e1": half + gap, "e2": half - gap})
    inv1 = F.when(F.abs("e1") > floor, 1.0 / F.col("e1")).otherwise(0.0)
    inv2 = F.when(F.abs("e2") > floor, 1.0 / F.col("e2")).otherwise(0.0)
    df = df.withColumns({"f1": inv1, "f2": inv2, "width": F.col("e1") - F.col("e2")})
    # Spectral projectors of a symmetric 2x2 matrix: P1 = (A - e2 I) / (e1 - e2).
    p11 = F.when(F.col("width") > 0, (F.col("i11") - F.col("e2")) / F.col("width")).otherwise(1.0)
    p12 = F.when(F.col("width") > 0, F.col("i12") / F.col("width")).otherwise(0.0)
    df = df.withColumns({"p11": p11, "p12": p12})
    return df.withColumns(
        {
            "v11": F.col("f1") * F.col("p11") + F.col("f2") * (1.0 - F.col("p11")),
            "v12": (F.col("f1") - F.col("f2")) * F.col("p12"),
            "v22": F.col("f1") * (1.0 - F.col("p11")) + F.col("f2") * F.col("p11"),
        }
    ).drop("e1", "e2", "f1", "f2", "width", "p11", "p12")
