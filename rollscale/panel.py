"""Vote panel derived from the TPC-H-ish driver tables with integer arithmetic.

Suppliers act as members, order lines as vote records, ship years as periods.
Every line of the table has a part in a cell: the lines of one member and item
are added up to one record. Cells outside a member's term or of a phantom member
have the absent code 9.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Limits, Weights
from .functions import votes as V
from .operators import screens, scoring
from .session import in_scans

ITEMS_PER_PERIOD = 200
TRUE_WEIGHTS = Weights(w1=1.0, w2=0.5, beta=6.0)


def true_position(member: Column, period: Column) -> tuple[Column, Column]:
    s = member - 1
    t1 = (s * 37) % 101 - 50 + (period - 4) * (s % 3 - 1) * 2
    t2 = (s * 53) % 97 - 48
    return t1, t2


def true_plane(rollcall: Column) -> tuple[Column, Column, Column]:
    n1 = (rollcall * 7) % 11 + 10
    n2 = (rollcall * 13) % 21 - 10
    cut = F.when(rollcall % 10 == 3, F.lit(-100000)).otherwise(
        ((rollcall * 17) % 81 - 40) * 10
    )
    return n1, n2, cut


def party_code(member: Column) -> Column:
    s = member - 1
    lean = (s * 37) % 101 - 50 + (s % 7) * 4 - 12
    return F.when(s % 17 == 0, 328).when(lean < 0, 100).otherwise(200)


class Panel:
    """Lazy tables of one scale directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        """Lines of one member, period and item as one record; each has a part in its sums."""
        line = self.table("lineitem").selectExpr(
            "l_suppkey + 1 as legislator_id",
            "cast(year(l_shipdate) - 1994 as int) as period",
            f"l_partkey % {ITEMS_PER_PERIOD} as slot",
            "l_orderkey",
            "l_linenumber",
            "l_returnflag = 'N' as open",
        )
        return line.groupBy("legislator_id", "period", "slot").agg(
            F.sum("l_orderkey").alias("o"),
            F.sum("l_linenumber").alias("ln"),
            F.min("open").alias("open_flag"),
            F.count("*").alias("lines"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        """legislator_id, period, rollcall_id, local_rc, code: one row per cell."""
        fields = self.records.selectExpr(
            "legislator_id",
            "period",
            f"(period - 1) * {ITEMS_PER_PERIOD} + slot as rollcall_id",
            "slot + 1 as local_rc",
            "legislator_id - 1 as s",
            "o",
            "ln",
            "open_flag",
        )
        t1, t2 = true_position(F.col("legislator_id"), F.col("period"))
        n1, n2, cut = true_plane(F.col("rollcall_id"))
        placed = fields.withColumn("low", n1 * t1 + n2 * t2 < cut).selectExpr(
            "*",
            "period >= s % 3 + 1"
            " and period <= case s % 4 when 0 then 4 when 1 then 6 else 7 end"
            " and not (s % 5 = 0 and period = 4) and s % 25 <> 24 as serving",
            "if(rollcall_id % 10 = 3, false, (o * 31 + ln * 7) % 10 = 0) as noise",
        )
        cells = placed.selectExpr(
            "legislator_id",
            "period",
            "rollcall_id",
            "local_rc",
            "cast(case when not serving then 9"
            " when open_flag and o % 3 = 0"
            " then case ln % 4 when 0 then 0 when 1 then 7 when 2 then 8 else 9 end"
            " when low <> noise then ln % 3 + 1 else ln % 3 + 4 end as int) as code",
        )
        # The votes table is derived once per session and folder: equal plans share
        # the cached copy, which spills to disk and is rebuilt where it gets lost.
        # There are at most as many cells as lines, whose count the file footers hold.
        cells = in_scans(cells, self.table("lineitem").count(), Limits().scan_rows)
        return cells.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def votes(self) -> DataFrame:
        return self.cells.withColumn("vote", V.vote_of(F.col("code")))

    @cached_property
    def valid_votes(self) -> DataFrame:
        return screens.drop_missing(self.votes)

    @cached_property
    def placements(self) -> DataFrame:
        return screens.placements(self.votes)

    @cached_property
    def state(self) -> DataFrame:
        """True positions of the served (member, period) pairs."""
        t1, t2 = true_position(F.col("legislator_id"), F.col("period"))
        return self.placements.select(
            "legislator_id",
            "period",
            (t1 / 60.0).alias("x1"),
            (t2 / 120.0).alias("x2"),
        )

    @cached_property
    def margins(self) -> DataFrame:
        return screens.margins(self.votes)

    @cached_property
    def bills(self) -> DataFrame:
        """True roll-call parameters with the screen result."""
        n1, n2, cut = true_plane(F.col("rollcall_id"))
        a, b = n1 * 60.0, n2 * 120.0
        norm2 = F.col("a") * F.col("a") + F.col("b") * F.col("b")
        m1, m2 = F.col("cut") * F.col("a") / norm2, F.col("cut") * F.col("b") / norm2
        out = F.greatest(F.lit(1.0), F.sqrt(F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2")))
        params = (
            self.margins.withColumns({"a": a, "b": b, "cut": cut.cast("double")})
            .withColumns({"m1": m1, "m2": m2, "norm": F.sqrt(norm2)})
            .select(
                "rollcall_id",
                "period",
                "yea",
                "nay",
                (F.col("m1") / out).alias("z1"),
                (F.col("m2") / out).alias("z2"),
                (F.col("a") * 0.3 / F.col("norm")).alias("d1"),
                (F.col("b") * 0.3 / F.col("norm")).alias("d2"),
            )
        )
        return screens.mark_valid(params)

    @cached_property
    def star(self) -> DataFrame:
        return scoring.star_join(self.valid_votes, self.state, self.bills)

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score(self.star, TRUE_WEIGHTS)

    @cached_property
    def fit_a(self) -> DataFrame:
        return self.state.select(
            "legislator_id",
            "period",
            F.col("x1").alias("coord1D"),
            F.col("x2").alias("coord2D"),
        )

    @cached_property
    def fit_b(self) -> DataFrame:
        """Fit A turned by a 3-4-5 rotation, mirrored, with small integer offsets."""
        m, p = F.col("legislator_id"), F.col("period")
        off1 = ((m * 13 + p * 7) % 11 - 5) / 500.0
        off2 = ((m * 17 + p * 3) % 13 - 6) / 500.0
        return self.state.select(
            "legislator_id",
            "period",
            (F.col("x1") * 0.8 - F.col("x2") * 0.6 + off1).alias("coord1D"),
            (-(F.col("x1") * 0.6 + F.col("x2") * 0.8) + off2).alias("coord2D"),
        )

    @cached_property
    def bills_b(self) -> DataFrame:
        rc = F.col("rollcall_id")
        return self.bills.select(
            "rollcall_id",
            "period",
            (F.col("z1") + (rc % 7 - 3) / 1000.0).alias("z1"),
            (F.col("z2") - (rc % 5 - 2) / 1000.0).alias("z2"),
            (F.col("d1") + (rc % 3 - 1) / 1000.0).alias("d1"),
            (F.col("d2") * 1.0).alias("d2"),
        )

    @cached_property
    def external(self) -> DataFrame:
        """Published-style scores: one per member, some of them null."""
        m = F.col("legislator_id")
        t1, t2 = true_position(m, F.lit(4))
        score1 = F.when(m % 10 != 0, t1 / 55.0 + (m % 5) / 100.0)
        return self.table("supplier").select(
            (F.col("s_suppkey") + 1).alias("legislator_id")
        ).select(
            "legislator_id",
            score1.alias("dim1"),
            (t2 / 110.0 - (m % 3) / 100.0).alias("dim2"),
        )

    @cached_property
    def roster_rows(self) -> DataFrame:
        """Roster file rows in file order: a base list, then a list of corrections."""
        base = self.table("supplier").select(
            (F.col("s_suppkey") + 1).alias("legislator_id"),
            F.col("s_name").alias("name"),
            (F.col("s_nationkey") + 30).cast("int").alias("state"),
        )
        m = F.col("legislator_id")
        return base.select(
            "*", F.explode(F.array(F.lit(1), F.lit(2))).alias("file_order")
        ).select(
            "legislator_id",
            "name",
            "state",
            F.when((F.col("file_order") == 2) & (m % 6 == 0), 328)
            .otherwise(party_code(m))
            .cast("int")
            .alias("party"),
            "file_order",
        )

    @cached_property
    def roster(self) -> DataFrame:
        return screens.last_wins(self.roster_rows, ["legislator_id"], "file_order")

    @cached_property
    def seeds_member(self) -> DataFrame:
        """Per-member seeds; null coordinates stand for members without a seed."""
        m = F.col("legislator_id")
        t1, t2 = true_position(m, F.lit(4))
        have = m % 9 != 0
        return self.table("supplier").select(
            (F.col("s_suppkey") + 1).alias("legislator_id")
        ).select(
            "legislator_id",
            F.when(have, t1 / 60.0).alias("x1"),
            F.when(have, t2 / 120.0).alias("x2"),
        )

    @cached_property
    def seeds_period(self) -> DataFrame:
        m, p = F.col("legislator_id"), F.col("period")
        have = (m % 4 == 0) & (p >= 3)
        return self.state.select(
            "legislator_id",
            "period",
            F.when(have, F.col("x1")).alias("x1"),
            F.when(have, F.col("x2")).alias("x2"),
        )

    @cached_property
    def trace(self) -> DataFrame:
        """One row per iteration, from the counts of one fortieth of the roll calls."""
        grouped = (
            self.margins.groupBy((F.col("rollcall_id") % 40 + 1).alias("iteration"))
            .agg(F.sum("yea").alias("yea"), F.sum("nay").alias("nay"))
        )
        return grouped.select(
            "iteration",
            (-(F.lit(20000.0) / F.col("iteration")) - F.col("yea") % 17).alias(
                "log_likelihood"
            ),
            ((F.col("nay") % 100) / 10.0 + 80.0).alias("classification_pct"),
            ((F.col("yea") % 23) / 100.0 + 0.3).alias("w2"),
            ((F.col("nay") % 31) / 50.0 + 5.0).alias("beta"),
            (F.col("yea") + F.col("nay")).alias("valid_votes"),
            F.col("yea").alias("correct"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Coordinates of four incremental runs; run 3 lacks the last period."""
        m, p, i = F.col("legislator_id"), F.col("period"), F.col("iteration")
        move = ((m * 7 + i * 5 + p) % 9 - 4) / (i * 100.0)
        return (
            self.state.select(
                "*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("iteration")
            )
            .where(~((i == 3) & (p == 7)))
            .select(
                "iteration",
                "legislator_id",
                "period",
                (F.col("x1") + move).alias("coord1D"),
                (F.col("x2") - move * 0.5).alias("coord2D"),
            )
        )

    @cached_property
    def bill_snapshots(self) -> DataFrame:
        rc, i = F.col("rollcall_id"), F.col("iteration")
        move = ((rc * 3 + i * 5) % 7 - 3) / (i * 100.0)
        return self.bills.select(
            "*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("iteration")
        ).select(
            "iteration",
            "rollcall_id",
            (F.col("z1") + move).alias("z1"),
            (F.col("z2") - move).alias("z2"),
            (F.col("d1") + move * 0.1).alias("d1"),
            F.col("d2"),
        )

    @cached_property
    def optimizer_trace(self) -> DataFrame:
        """Block attempts: one row per roll call and one per served placement."""
        items = self.margins.select(
            F.col("period").alias("iteration"),
            F.lit("rollcall").alias("block"),
            F.col("rollcall_id").alias("item_index"),
            "yea",
            "nay",
        )
        actors = (
            self.valid_votes.groupBy("legislator_id", "period")
            .agg(F.count_if("vote").alias("yea"), F.count_if(~F.col("vote")).alias("nay"))
            .select(
                F.col("period").alias("iteration"),
                F.lit("legislator").alias("block"),
                F.col("legislator_id").alias("item_index"),
                "yea",
                "nay",
            )
        )
        yea, nay = F.col("yea"), F.col("nay")
        n = yea + nay
        attempted = F.least(yea, nay) > 0
        accepted = attempted & (n % 9 != 0)
        feasible = accepted | (yea % 2 == 1)
        bad = nay % 3
        return items.unionByName(actors).select(
            "iteration",
            "block",
            "item_index",
            (n * -0.7).alias("initial_log_likelihood"),
            (n * -0.7 + ((yea * 3 + nay) % 8) / 4.0).alias("final_log_likelihood"),
            (((yea * 3 + nay) % 8) / 4.0).alias("improvement"),
            (n % 13 + 4).alias("objective_evaluations"),
            attempted.cast("int").alias("attempted"),
            accepted.cast("int").alias("accepted"),
            feasible.cast("int").alias("raw_return_feasible"),
            F.lit(1e-8).alias("constraint_tolerance"),
            F.when(feasible, 0.0)
            .otherwise((yea % 5 + 1) / 1000.0)
            .alias("raw_constraint_violation"),
            (accepted & (yea % 7 == 0)).cast("int").alias("numerical_correction_applied"),
            bad.alias("infeasible_objective_evaluations"),
            (bad / 10000.0).alias("max_objective_constraint_violation"),
        )
