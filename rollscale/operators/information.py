"""Information matrices of member paths, their pseudo-inverses and standard errors.

A path of order q has 2 (q + 1) coefficients, term by term and dimension by dimension.  Matrices
are symmetric and travel packed, the upper triangle row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trend
from ..functions.kernels import bounded_inverse
from ..session import ship_package

FLOOR = 1e-4


def packed_place(i: int, j: int, width: int) -> int:
    """Place of cell (i, j), i <= j, among the packed cells."""
    return i * width - i * (i - 1) // 2 + j - i


def path_information(terms: DataFrame, grid: DataFrame, order: int) -> DataFrame:
    """legislator_id, eff_order, votes and the packed sums of outer products of the path terms.

    terms: votes with gx1 and gx2; grid: the served grid.  All sums are partial aggregates, so a
    member's votes are never together.  The matrix is that of the full `order`; a member of a
    lower effective order uses its leading part.
    """
    basis = ["1.0D", "p1", "p2", "p3"][: order + 1]
    rows = terms.select("legislator_id", "period", "gx1", "gx2").join(
        grid.select("legislator_id", "period", "served", "p1", "p2", "p3"),
        ["legislator_id", "period"],
    )
    names = [f"gx{k} * {b}" for b in basis for k in (1, 2)]
    rows = rows.selectExpr(
        "legislator_id", "served", *[f"{text} as x{i}" for i, text in enumerate(names)]
    )
    cells = [f"sum(x{i} * x{j})" for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy("legislator_id").agg(
        trend.effective_order(F.first("served"), order).alias("eff_order"),
        F.count("*").alias("votes"),
        F.expr(f"array({', '.join(cells)})").alias("information"),
    )


def path_covariance(information: DataFrame, order: int, floor: float = FLOOR) -> DataFrame:
    """legislator_id, eff_order, rank and the packed inverse over eigenvalues above the floor.

    A lower effective order has a smaller matrix; its other cells are zero.
    """
    ship_package(information.sparkSession)
    width = 2 * (order + 1)
    upper = np.triu_indices(width)

    def invert(batches):
        for batch in batches:
            packed = batch.column("information").flatten().to_numpy(zero_copy_only=False)
            packed = packed.reshape(batch.num_rows, len(upper[0]))
            whole = np.zeros((batch.num_rows, width, width))
            whole[:, upper[0], upper[1]] = packed
            whole[:, upper[1], upper[0]] = packed
            kept = batch.column("eff_order").to_numpy(zero_copy_only=False)
            out, rank = np.zeros_like(whole), np.zeros(len(whole), np.int32)
            for q in range(order + 1):
                mine, n = np.flatnonzero(kept == q), 2 * (q + 1)
                part = whole[mine, :n, :n]
                out[np.ix_(mine, range(n), range(n))] = bounded_inverse(part, floor)
                rank[mine] = (np.abs(np.linalg.eigvalsh(part)) > floor).sum(axis=1)
            cells = out[:, upper[0], upper[1]]
            offsets = np.arange(0, cells.size + 1, len(upper[0]), dtype=np.int32)
            yield pa.record_batch(
                {
                    "legislator_id": batch.column("legislator_id"),
                    "eff_order": batch.column("eff_order"),
                    "rank": pa.array(rank),
                    "covariance": pa.ListArray.from_arrays(offsets, pa.array(cells.reshape(-1))),
                }
            )

    schema = "legislator_id bigint, eff_order int, rank int, covariance array<double>"
    return information.select("legislator_id", "eff_order", "information").mapInArrow(invert, schema)


def cells(packed: DataFrame, column: str, order: int) -> DataFrame:
    """One row per cell (i, j), 1-based, of the matrix that a member's effective order has."""
    width = 2 * (order + 1)
    places = [
        f"struct({i + 1} as i, {j + 1} as j, {column}[{packed_place(i, j, width)}] as value)"
        for i in range(width)
        for j in range(i, width)
    ]
    others = [c for c in packed.columns if c not in ("information", "covariance")]
    rows = packed.select(*others, F.expr(f"inline(array({', '.join(places)}))"))
    return rows.where(F.col("j") <= 2 * (F.col("eff_order") + 1))


def line_moments(covariance: DataFrame, order: int) -> DataFrame:
    """v0, v1 and c01 per dimension: variances of intercept and slope and their covariance, zero
    slopes for constant paths."""
    width = 2 * (order + 1)
    out = []
    for k in (0, 1):
        places = {"v0": (k, k), "v1": (2 + k, 2 + k), "c01": (k, 2 + k)}
        for name, (i, j) in places.items():
            at = packed_place(i, j, width) if order else packed_place(k, k, width)
            value = F.col("covariance")[at] if order or name == "v0" else F.lit(0.0)
            out.append(value.alias(f"{name}_{k + 1}"))
    return covariance.select("legislator_id", "eff_order", "rank", *out)
