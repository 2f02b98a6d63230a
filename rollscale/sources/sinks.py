"""Result tables and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import LIMITS, row_numbers


def coordinates(state: DataFrame, flipped: bool = False) -> DataFrame:
    """Served positions with the effective order; `flipped` negates both dimensions."""
    sign = -1.0 if flipped else 1.0
    return state.select(
        "legislator_id",
        "period",
        (F.col("x1") * sign).alias("coord1D"),
        (F.col("x2") * sign).alias("coord2D"),
        F.col("eff_order").alias("effective_model"),
    )


_BILL = {"z1": "midpoint1D", "z2": "midpoint2D", "d1": "spread1D", "d2": "spread2D"}


def bill_params(bills: DataFrame) -> DataFrame:
    return bills.select("rollcall_id", *[F.col(a).alias(b) for a, b in _BILL.items()])


def local_ids(bills: DataFrame, limits=LIMITS) -> DataFrame:
    """Position of a roll call inside its period, from 1."""
    return row_numbers(bills, ["period"], ["rollcall_id"], "local_id", limits)


def reloadable_bills(bills: DataFrame, limits=LIMITS) -> DataFrame:
    """(session, ID) parameters; missing values become 0."""
    numbered = local_ids(bills, limits)
    return numbered.select(
        F.col("period").alias("session"),
        F.col("local_id").alias("ID"),
        *[F.coalesce(F.col(a), F.lit(0.0)).alias(b) for a, b in _BILL.items()],
    )


def coefficients(paths: DataFrame) -> DataFrame:
    return paths.select(
        "legislator_id",
        F.col("served").alias("served_periods"),
        F.col("eff_order").alias("effective_model"),
        *[
            F.col(f"b{j}_{k}").alias(f"beta{j}_dim{k}")
            for j in range(4)
            for k in (1, 2)
        ],
        F.hypot("b0_1", "b0_2").alias("intercept_radius"),
    )


def summary(one_row: DataFrame) -> DataFrame:
    """One typed row to parameter,value lines."""
    names = one_row.columns
    pairs = [
        F.struct(F.lit(n).alias("parameter"), F.col(n).cast("string").alias("value"))
        for n in names
    ]
    return one_row.select(F.inline(F.array(*pairs)))


TRACE = ("iteration", "log_likelihood", "w2", "beta", "delta_log_likelihood")
METRICS = (
    "iteration",
    "log_likelihood",
    "classification_pct",
    "w2",
    "beta",
    "coord_change_l2",
    "coord_change_max",
    "coord_change_mean",
    "bill_change_l2",
)


def metrics(trace: DataFrame, coord_changes: DataFrame, bill_changes: DataFrame) -> DataFrame:
    """Convergence metrics: the trace with the changes of coordinates and roll calls."""
    coords = coord_changes.select(
        "iteration",
        F.col("change_l2").alias("coord_change_l2"),
        F.col("change_largest").alias("coord_change_max"),
        F.col("change_mean").alias("coord_change_mean"),
    )
    bills = bill_changes.select("iteration", F.col("change_l2").alias("bill_change_l2"))
    joined = trace.join(coords, "iteration", "left").join(bills, "iteration", "left")
    return joined.select(
        "iteration", *[F.round(c, 6).alias(c) for c in METRICS if c != "iteration"]
    )


def write_csv(df: DataFrame, path: str, by: str | None = None) -> str:
    writer = df.write.mode("errorifexists").option("header", True)
    if by:
        writer = writer.partitionBy(by)
    writer.csv(path)
    return path


def write_trace(df: DataFrame, path: str) -> str:
    """Block attempts appended as parquet, one folder per cycle."""
    df.write.mode("append").partitionBy("iteration").parquet(path)
    return path


def write_fit(state: DataFrame, bills: DataFrame, one_row: DataFrame, folder: str) -> str:
    """A fit that `evaluate` can reload: coordinates, roll calls and the summary."""
    write_csv(coordinates(state), f"{folder}/coordinates")
    write_csv(reloadable_bills(bills), f"{folder}/bill_parameters")
    write_csv(summary(one_row), f"{folder}/summary")
    return folder


def by_slot() -> Column:
    """Aggregate: (local_rc, code) of a group in the order of roll calls."""
    return F.sort_array(F.collect_list(F.struct("local_rc", "code")))


def filled_slots(codes: Column, width: int | Column, mark: str = "") -> Column:
    """Codes of roll calls 1 to width as one text, each after `mark`; 9 where a slot has none.

    codes is what by_slot gives, or null. Work is in proportion to the width. A roll call that
    comes twice or lies outside the width raises an error, so no cell is lost.
    """

    def empty(before: Column, after: Column) -> Column:
        gap = (after - before - 1).cast("int")
        lost = F.raise_error(F.lit("a roll call is repeated or outside the matrix"))
        return F.repeat(F.lit(mark + "9"), F.when(gap >= 0, gap).otherwise(lost))

    def slot_after(i: Column) -> Column:
        return F.coalesce(F.get(codes, i)["local_rc"], F.lit(width) + 1)

    filled = F.transform(
        codes,
        lambda pair, i: F.concat(
            F.lit(mark),
            F.coalesce(pair["code"], F.lit(9)).cast("string"),
            empty(pair["local_rc"], slot_after(i + 1)),
        ),
    )
    head = empty(F.lit(0), slot_after(F.lit(0)))
    return F.concat(head, F.coalesce(F.array_join(filled, ""), F.lit("")))


def wide_matrix_lines(cells: DataFrame, width: int, prefix: str = "rc") -> DataFrame:
    """Padded wide matrix as text lines per period; a group holds one member's period."""
    rows = cells.groupBy("legislator_id", "period").agg(by_slot().alias("codes")).select(
        "period",
        F.concat(
            F.col("legislator_id").cast("string"), filled_slots(F.col("codes"), width, ",")
        ).alias("line"),
    )
    header = ",".join(["", *[f"{prefix}{i}" for i in range(1, width + 1)]])
    heads = cells.select("period").distinct().select("period", F.lit(header).alias("line"))
    return heads.unionByName(rows)


def padded_rows(cells: DataFrame, roster: DataFrame, periods: int, width: int) -> DataFrame:
    """Full roster in every period, one row per member: a digit per roll call, absent = 9.

    The padding lives inside the row, so the members never multiply with the roll calls. A cell
    outside the periods or the width raises an error.
    """
    lost = F.raise_error(F.lit("a period is outside the panel"))
    known = F.when(F.col("period").between(1, periods), F.col("period")).otherwise(lost)
    codes = (
        cells.withColumn("period", known)
        .groupBy("legislator_id", "period")
        .agg(by_slot().alias("codes"))
    )
    every = roster.select(
        "legislator_id", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("period")
    )
    return every.join(codes, ["legislator_id", "period"], "left").select(
        "legislator_id", "period", filled_slots(F.col("codes"), width).alias("line")
    )


def report_json(*tables: tuple[str, DataFrame]) -> DataFrame:
    """One JSON document per one-row table, for an audit report."""
    out = None
    for name, df in tables:
        part = df.select(
            F.lit(name).alias("section"), F.to_json(F.struct(*sorted(df.columns))).alias("document")
        )
        out = part if out is None else out.unionByName(part)
    return out
