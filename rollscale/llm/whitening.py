"""Whitening of embeddings by a bit-sliced scatter matrix (operator 13)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm.common import in_python, stored
from rollscale.llm.vectors import embeddings, finite, lists, matrix, steps

SCALE = 256
COMPONENTS = 4
LONG = 2**63


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x = floor(scale * component) as longs; beyond the range of a long, its ends."""
    return finite(df).select(
        "vec_id", F.transform("vector", lambda c: F.floor(c * F.lit(float(scale)))).alias("x")
    )


def planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """(dimension * bits, words): bit p of every row of a dimension, 64 rows to a word."""
    rows, width = shifted.shape
    words = -(-rows // 64)
    out = np.zeros((width, bits, words * 8), np.uint8)
    for p in range(bits):
        plane = (shifted >> np.uint64(p)) & np.uint64(1)
        packed = np.packbits(plane.astype(np.uint8), axis=0, bitorder="little")
        out[:, p, : packed.shape[0]] = packed.T
    return out.view(np.uint64).reshape(width * bits, words)


def cross_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and sums of products over the rows of an integer matrix, as Python integers.

    Every dimension is shifted by its least value, so its bit planes are those of small numbers
    without a sign. The AND of two planes counts the rows in which both bits are set; counts
    weighted with 2^(p+q) add up to the product of the shifted dimensions.
    """
    rows, width = x.shape
    least = x.min(axis=0)
    shifted = (x - least).view(np.uint64)  # wraps around where the range needs 64 bits
    bits = max(1, int(shifted.max()).bit_length())
    p = planes(shifted, bits)
    counts = np.zeros((width * bits, width * bits), np.int64)
    for k in range(width * bits):
        both = np.bitwise_count(p[k] & p[k:]).sum(axis=1, dtype=np.int64)
        counts[k, k:] = both
        counts[k:, k] = both
    counts = counts.reshape(width, bits, width, bits)
    whole = np.int64 if 2 * bits + int(rows).bit_length() < 62 else object
    weight = np.array([1 << b for b in range(bits)], dtype=whole)
    products = ((counts.astype(whole) * weight).sum(axis=3) * weight[:, None]).sum(axis=1)
    ones = counts[:, range(bits), :, range(bits)]  # (bit, dimension, dimension)
    ones = ones[:, range(width), range(width)].astype(whole)
    sums = (ones * weight[:, None]).sum(axis=0).astype(object)
    least = least.astype(object)
    # sum (u + a)(v + b) = sum uv + a sum v + b sum u + rows a b
    products = (
        products.astype(object)
        + least[:, None] * sums[None, :]
        + sums[:, None] * least[None, :]
        + rows * least[:, None] * least[None, :]
    )
    return list(sums + rows * least), products.tolist()


def _scatter(batches):
    """One record per sum: (i, -1) of a dimension, (i, j) of a product; digits as text."""
    n, total, product = 0, None, None
    for batch in steps(batches):
        x = matrix(batch.column("x")).astype(np.int64)
        sums, products = (np.array(v, dtype=object) for v in cross_products(x))
        n += len(x)
        total = sums if total is None else total + sums
        product = products if product is None else product + products
    if n == 0:
        return
    width = len(total)
    cells = [(-1, -1, n)] + [(i, -1, total[i]) for i in range(width)]
    cells += [(i, j, product[i, j]) for i in range(width) for j in range(i, width)]
    i, j, value = zip(*cells, strict=True)
    yield pa.record_batch(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32())]
        + [pa.array(part, pa.int64()) for part in zip(*map(limbs, value), strict=True)],
        names=["i", "j", "low", "middle", "high"],
    )


def limbs(value: int) -> tuple[int, int, int]:
    """An integer of any realistic size as longs: low + middle * 2^60 + high * 2^120."""
    rest, low = divmod(value, 1 << 60)
    high, middle = divmod(rest, 1 << 60)
    return low, middle, high


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, unit eigenvectors (columns), eigenvalues and their trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; NaN for a component without variance."""
        mean = [divmod(s, self.n) for s in self.sums]  # whole and remaining part, kept apart
        whole = np.array([w for w, _ in mean], dtype=np.int64)
        part = np.array([r / self.n for _, r in mean])
        wide = max(int(x.max(initial=0)), -int(x.min(initial=0))) >= LONG // 4
        centred = (x.astype(object if wide else np.int64) - whole).astype(np.float64) - part
        usable = self.values > 0
        scale = np.where(usable, np.sqrt(np.where(usable, self.values, 1.0)), np.nan)
        # not a matrix product, whose rounding may depend on the place of a row in its batch
        return np.einsum("ij,jk->ik", centred, self.vectors) / scale

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - sum)^2 by row, exact."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        bound = self.n * most + max(map(abs, self.sums))
        kind = np.int64 if len(self.sums) * bound * bound < LONG else object
        gap = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return (gap * gap).sum(axis=1).tolist()


def solve(n: int, sums: list[int], products: list[list[int]], components: int) -> Whitening:
    """Eigenvectors of the covariance, whose entries are centred as integers:
    n^2 cov = n * sum(x y) - sum(x) sum(y), rounded once."""
    width = len(sums)
    cov = np.empty((width, width))
    for i in range(width):
        for j in range(width):
            cov[i, j] = (n * products[i][j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(cov))
    values = np.where(values > trace * width * np.finfo(float).eps, values, 0.0)
    return Whitening(n, sums, vectors[:, :components].copy(), values[:components].copy(), trace)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of x vectors, None without rows.

    Tasks send a sum per pair of dimensions, never vectors; the driver gets those sums, whose
    number is bounded by the square of the width.
    """
    parts = in_python(
        distinct.select("x"), _scatter, "i int, j int, low long, middle long, high long"
    )
    cells = (
        parts.groupBy("i", "j")
        .agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "middle", "high")))
        .collect()
    )
    if not cells:
        return None
    found = {
        (c.i, c.j): int(c.low) + (int(c.middle) << 60) + (int(c.high) << 120) for c in cells
    }
    width = max(c.i for c in cells) + 1
    products = [[found[min(i, j), max(i, j)] for j in range(width)] for i in range(width)]
    return solve(found[-1, -1], [found[i, -1] for i in range(width)], products, components)


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity,
    measured over its rows; components without variance are left out, None if all are."""
    used = np.flatnonzero(model.values > 0)
    if not len(used):
        return None

    def moments(batches):
        n, first, second = 0, 0.0, 0.0
        for batch in steps(batches):
            w = model.project(matrix(batch.column("x")).astype(np.int64))[:, used]
            n, first, second = n + len(w), first + w.sum(axis=0), second + w.T @ w
        if n:
            yield pa.record_batch({"moments": lists(np.vstack([first, second]).reshape(1, -1))})

    k = len(used)
    parts = in_python(distinct.select("x"), moments, "moments array<double>")
    total = parts.agg(*(F.sum(F.col("moments")[c]).alias(f"m{c}") for c in range(k + k * k))).first()
    total = np.array(total, dtype=float) / model.n
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: one row for each
    row with a usable vector (see vectors.finite) and each of the first `components` components.

    The fit list holds every distinct x = floor(scale * vector) once, so copies, however many,
    weigh as one; they fold before they are shuffled. Components are numbered by falling
    eigenvalue; equal eigenvalues leave the choice of axes to the eigen solver. Whitened and
    explained are null where the data have no variance (explained: none at all), identity_error
    is null if no component has any. deviation is a decimal and exact. Repeated rows and null ids
    keep their rows; no usable vector gives no rows; other columns are not read.
    """
    rows = quantised(df, scale)
    distinct = stored(rows.select("x").distinct(), "whitening-fit")
    model = fit(distinct, components)
    schema = (
        "vec_id long, component int, n long, deviation string, whitened double, explained double"
    )
    if model is None:
        out = rows.sparkSession.createDataFrame([], schema)
        error = None
    else:
        error = identity_error(distinct, model)

        def apply(batches):
            share = model.values / model.trace if model.trace > 0 else model.values * np.nan
            k = len(model.values)
            for batch in steps(batches):
                x = matrix(batch.column("x")).astype(np.int64)
                deviation = pa.array([str(v) for v in model.deviation(x)], pa.string())
                at = np.repeat(np.arange(len(x)), k)
                yield pa.record_batch(
                    {
                        "vec_id": batch.column("vec_id").take(pa.array(at)),
                        "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        "n": pa.array(np.full(len(at), model.n), pa.int64()),
                        "deviation": deviation.take(pa.array(at)),
                        "whitened": pa.array(model.project(x).reshape(-1), from_pandas=True),
                        "explained": pa.array(np.tile(share, len(x)), from_pandas=True),
                    }
                )

        out = in_python(rows, apply, schema)
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumn(
        "identity_error", F.lit(error).cast("double")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond the range of a long is null here; `whiten` has it as a decimal."""
    out = whiten(embeddings(spark, sf_dir))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


SQL = None
