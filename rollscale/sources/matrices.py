"""Vote files: wide matrices per period, long records, legacy fixed-width records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import votes as V
from ..operators.screens import last_wins

# File name of a wide matrix; without a period it is period 1.
MATRIX_NAME = r"votes_matrix(?:_p=?(\d+))?"


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file and an order that follows the file."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("line_order"),
    )


def period_of(file: Column) -> Column:
    number = F.regexp_extract(file, MATRIX_NAME, 1)
    return F.coalesce(number.try_cast("int"), F.lit(1))


def periods_found(spark: SparkSession, path: str) -> DataFrame:
    """Periods named by the matrix files of a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias("file"))
    )
    return files.where(F.col("file").rlike(MATRIX_NAME)).select(
        period_of(F.col("file")).alias("period")
    ).distinct()


def _cells(line: Column) -> Column:
    """Cells of a line; commas inside double quotes belong to the cell."""
    quoted = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(',("(?:[^"]++|"")*+"[^,]*|[^,]*)'), F.lit(1)
    )
    cells = F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ","))
    return F.transform(cells, lambda c: V.unquote(c))


def read_vote_matrices(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Wide matrices to long cells (legislator_id, period, local_rc, rollcall_key, code).

    Lines are split and exploded, so a matrix with very many columns never becomes a
    wide schema.  A line whose first cell is no number is the header of its file.  Of
    repeated members in one matrix the last line wins; unreadable cells become -1.
    """
    lines = text_lines(spark, path).where(F.trim("line") != "")
    split = lines.select(
        period_of(F.col("file")).alias("period"), "line_order", _cells(F.col("line")).alias("cells")
    ).withColumn("legislator_id", F.col("cells")[0].try_cast("bigint"))
    header = (
        split.where(F.col("legislator_id").isNull())
        .select("period", F.posexplode("cells").alias("local_rc", "rollcall_key"))
        .where(F.col("local_rc") > 0)
        .groupBy("period", "local_rc")
        .agg(F.min("rollcall_key").alias("rollcall_key"))
    )
    rows = last_wins(
        split.where(F.col("legislator_id").isNotNull()),
        ["legislator_id", "period"],
        "line_order",
    )
    cells = rows.select(
        "legislator_id", "period", F.posexplode("cells").alias("local_rc", "cell")
    ).where(F.col("local_rc") > 0)
    return (
        cells.withColumn("code", V.parse_int(F.col("cell"), -1))
        .join(header, ["period", "local_rc"], "left")
        .select("legislator_id", "period", "local_rc", "rollcall_key", "code")
    )


def read_vote_records(spark: SparkSession, path: str | list[str], period: int | None = None) -> DataFrame:
    """Long vote records: icpsr, rollnumber, cast_code and optionally period."""
    schema = "icpsr bigint, rollnumber int, cast_code int, period int"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    df = rows.csv(path)
    if period is not None:
        df = df.withColumn("period", F.lit(period))
    return df.select(
        F.col("icpsr").alias("legislator_id"),
        "period",
        F.col("rollnumber").alias("local_rc"),
        F.col("cast_code").alias("code"),
    )


def global_ids(cells: DataFrame) -> DataFrame:
    """Give long cells a global roll-call id: period offset + local id - 1.

    The width of a period is its largest local id, one row per period.
    """
    from ..operators.running import Running, running

    widths = cells.groupBy("period").agg(F.max("local_rc").cast("bigint").alias("n"))
    offsets = running(widths, [], ["period"], {"rc_offset": Running(F.col("n"))}).drop("n")
    return cells.join(offsets, "period").withColumn(
        "rollcall_id", F.col("rc_offset") + F.col("local_rc") - 1
    )


# Legacy record layouts as (name, start, width, type); starts are 1-based.
ITEM_STARTS = (
    ("period", 1, 3, "int"),
    ("number", 4, 5, "int"),
    ("spread1", 9, 7, "double"),
    ("mid1", 16, 7, "double"),
    ("spread2", 23, 7, "double"),
    ("mid2", 30, 7, "double"),
)
MEMBER_STARTS = (
    ("period", 1, 4, "int"),
    ("legislator_id", 5, 6, "bigint"),
    ("state", 11, 3, "int"),
    ("district", 14, 2, "int"),
    ("state_name", 17, 7, "string"),
    ("party", 25, 4, "int"),
    ("name", 30, 11, "string"),
    ("x1", 41, 7, "double"),
    ("x2", 48, 7, "double"),
)
PERIOD_SIZES = (
    ("period", 1, 3, "int"),
    ("n_rollcalls", 5, 4, "int"),
    ("n_members", 9, 4, "int"),
    ("n_parties", 13, 4, "int"),
)
ITEM_VOTES_PREFIX = (("period", 1, 4, "int"), ("number", 5, 5, "int"))
ITEM_VOTES_START = 11
MEMBER_VOTES_PREFIX = MEMBER_STARTS[:7]
MEMBER_VOTES_START = 41


def _slices(layout) -> list[Column]:
    return [
        F.trim(F.substring("line", start, width)).try_cast(kind).alias(name)
        for name, start, width, kind in layout
    ]


def read_fixed_width(spark: SparkSession, path: str | list[str], layout) -> DataFrame:
    lines = text_lines(spark, path).where(F.trim("line") != "")
    return lines.select(*_slices(layout))


def read_fixed_width_votes(
    spark: SparkSession, path: str | list[str], prefix, votes_start: int
) -> DataFrame:
    """Prefix fields and one row per one-digit code (slot is 1-based)."""
    lines = text_lines(spark, path).where(F.trim("line") != "")
    codes = F.split(F.rtrim(F.expr(f"substring(line, {int(votes_start)})")), "")
    return (
        lines.select(*_slices(prefix), F.posexplode(codes).alias("slot", "digit"))
        .where(F.col("digit") != "")
        .select(
            *[name for name, *_ in prefix],
            (F.col("slot") + 1).alias("slot"),
            F.col("digit").try_cast("int").alias("code"),
        )
    )


def read_fixed_width_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Member starts with the slot of every member: the number of its line within the period.

    Lines are numbered by `running`, so a period with very many lines is numbered in blocks.
    """
    from ..operators.running import Running, running

    lines = text_lines(spark, path).where(F.trim("line") != "")
    members = lines.select(*_slices(MEMBER_STARTS), "line_order")
    numbered = running(
        members, ["period"], ["line_order"], {"slot": Running(F.lit(1).cast("long"), span="upto")}
    )
    return numbered.drop("line_order")


def read_fixed_width_item_votes(
    spark: SparkSession, path: str | list[str], members: str | list[str]
) -> DataFrame:
    """Transposed votes: a line per roll call, a digit per member of its period.

    Digits stand in the order of the member lines of the same period, so the record is turned
    round by a join of (period, slot); a digit beyond the last member raises an error.
    """
    votes = read_fixed_width_votes(spark, path, ITEM_VOTES_PREFIX, ITEM_VOTES_START)
    slots = read_fixed_width_members(spark, members).select(
        "period", F.col("slot").cast("int").alias("slot"), "legislator_id"
    )
    beyond = F.raise_error(F.lit("a roll call has more votes than its period has members"))
    return votes.join(slots, ["period", "slot"], "left").select(
        F.coalesce("legislator_id", beyond.cast("bigint")).alias("legislator_id"),
        "period",
        "number",
        "code",
    )
