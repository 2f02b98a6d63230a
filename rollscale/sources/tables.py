"""Parameter tables: rosters, seeds, starts, fits, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import votes as V
from ..operators.screens import last_wins
from .matrices import text_lines


def _csv(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Header-matched CSV with every cell as text, quotes removed from headers."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    df = df.toDF(*[c.strip().strip('"') for c in df.columns])
    missing = sorted(set(columns or []) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "line_order",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("seq"),
        ),
    )


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Five-field roster (id, name, party, region, district); last line of an id wins."""
    df = spark.read.option("header", True).csv(path)
    if len(df.columns) < 5:
        raise ValueError("a roster needs at least five fields")
    id_col, _, name, party, region, district = (df.columns + [df.columns[-1]])[:6]
    if len(df.columns) == 5:
        id_col, name, party, region, district = df.columns
    rows = _ordered(df).select(
        F.col(id_col).try_cast("bigint").alias("legislator_id"),
        F.trim(name).alias("name"),
        F.trim(party).alias("party"),
        F.trim(region).alias("region"),
        F.trim(district).alias("district"),
        "line_order",
    )
    return last_wins(rows.where(F.col("legislator_id") > 0), ["legislator_id"], "line_order")


def read_member_seeds(spark: SparkSession, path: str) -> DataFrame:
    """coord1D, coord2D, legislator_id, ...; positive ids, last line wins."""
    df = spark.read.option("header", True).csv(path)
    rows = _ordered(df).select(
        F.col("legislator_id").try_cast("bigint").alias("legislator_id"),
        V.parse_double(F.col("coord1D"), 0.0).alias("x1"),
        V.parse_double(F.col("coord2D"), 0.0).alias("x2"),
        "line_order",
    )
    return last_wins(rows.where(F.col("legislator_id") > 0), ["legislator_id"], "line_order")


def read_period_seeds(spark: SparkSession, path: str) -> DataFrame:
    """legislator_id, period, coord1D, coord2D; positive ids and periods."""
    df = spark.read.option("header", True).csv(path)
    if len(df.columns) < 4:
        raise ValueError("per-period seeds need at least four columns")
    rows = _ordered(df).select(
        F.col("legislator_id").try_cast("bigint").alias("legislator_id"),
        F.col("period").try_cast("int").alias("period"),
        V.parse_double(F.col("coord1D"), 0.0).alias("x1"),
        V.parse_double(F.col("coord2D"), 0.0).alias("x2"),
        "line_order",
    )
    good = rows.where((F.col("legislator_id") > 0) & (F.col("period") > 0))
    return last_wins(good, ["legislator_id", "period"], "line_order")


def rejected_period_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a per-period seed file that the reader leaves out."""
    df = spark.read.option("header", True).csv(path)
    bad_id = F.coalesce(F.col("legislator_id").try_cast("bigint") > 0, F.lit(False))
    bad_period = F.coalesce(F.col("period").try_cast("int") > 0, F.lit(False))
    return df.where(~bad_id | ~bad_period)


def read_bill_params(spark: SparkSession, path: str) -> DataFrame:
    """session, ID and four starts; valid only when all four are present."""
    df = _csv(spark, path, ["session", "ID", "midpoint1D", "midpoint2D", "spread1D", "spread2D"])
    out = df.select(
        F.col("session").try_cast("int").alias("session"),
        F.col("ID").try_cast("int").alias("ID"),
        V.parse_double(F.col("midpoint1D")).alias("z1"),
        V.parse_double(F.col("midpoint2D")).alias("z2"),
        V.parse_double(F.col("spread1D")).alias("d1"),
        V.parse_double(F.col("spread2D")).alias("d2"),
    )
    complete = F.lit(True)
    for c in ("z1", "z2", "d1", "d2"):
        complete = complete & F.col(c).isNotNull()
    return out.withColumn("given", complete.cast("int"))


def read_reference_fit(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Fourteen-column fit export; the first readable path is preferred."""
    last = None
    for path in paths:
        try:
            df = spark.read.option("header", True).csv(path)
        except Exception as error:  # the preferred file may not exist
            if "PATH_NOT_FOUND" not in str(error):
                raise
            last = error
            continue
        if len(df.columns) < 14:
            raise ValueError("a reference fit needs fourteen columns")
        numbers = (
            "coord1D", "coord2D", "se1D", "se2D", "var1D", "var2D", "loglikelihood", "GMP",
        )
        return df.select(
            F.col("period").try_cast("int").alias("period"),
            F.col("legislator").try_cast("bigint").alias("legislator_id"),
            F.trim("party").alias("party"),
            F.trim("name").alias("name"),
            *[V.parse_double(F.col(c)).alias(c) for c in numbers],
            F.col("numVotes").try_cast("bigint").alias("numVotes"),
            F.col("numErrors").try_cast("bigint").alias("numErrors"),
        )
    raise last or ValueError("no path given")


COORDINATE_COLUMNS = ["legislator_id", "period", "coord1D", "coord2D"]


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, COORDINATE_COLUMNS)
    return df.select(
        F.col("legislator_id").try_cast("bigint").alias("legislator_id"),
        F.col("period").try_cast("int").alias("period"),
        V.parse_double(F.col("coord1D")).alias("coord1D"),
        V.parse_double(F.col("coord2D")).alias("coord2D"),
    )


SUMMARY_NUMBERS = ("log_likelihood", "classification_pct", "valid_votes", "correct_classifications", "w2", "beta")


def summary_row(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """key,value pairs to one typed row per group."""
    by = by or []
    return pairs.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("parameter") == n, F.col("value").try_cast("double"))).alias(n)
            for n in SUMMARY_NUMBERS
        ]
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return summary_row(_csv(spark, path, ["parameter", "value"]))


RUN_FOLDER = r"iter_0*(\d+)"


def _run_of(file):
    return F.regexp_extract(file, RUN_FOLDER, 1).cast("int")


def read_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Summaries (one row per run) and coordinate snapshots of iter_N folders."""
    option = spark.read.option("header", True)
    pairs = (
        option.schema("parameter string, value string")
        .csv(f"{folder}/iter_*/summary*")
        .withColumn("iteration", _run_of(F.col("_metadata.file_path")))
    )
    coords = (
        option.schema("legislator_id bigint, period int, coord1D double, coord2D double")
        .csv(f"{folder}/iter_*/coordinates*")
        .withColumn("iteration", _run_of(F.col("_metadata.file_path")))
    )
    return summary_row(pairs, ["iteration"]), coords.select("iteration", *COORDINATE_COLUMNS)


# Lines of a verbose run log.
LOG_CYCLE = r"^\s*=== Iteracion global (\d+) ==="
LOG_W2 = r"\[WINT\] W2:\s*([\d.]+)\s*->\s*([\d.]+),\s*LL:\s*([-\d.]+)"
LOG_BETA = r"\[SIGMAS\] Beta:\s*([\d.]+)\s*->\s*([\d.]+),\s*LL:\s*([-\d.]+)"
LOG_CLASS = r"Clasificacion:\s*(\d+)/(\d+)\s*\(([\d.]+)%\)"


def read_run_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Verbose logs to one row per file and cycle.

    Every line belongs to the last cycle banner above it; carrying the banner forward
    is a running maximum over the line order, so a long log is not one task's work.
    """
    from ..operators.running import Running, running

    lines = text_lines(spark, path)
    found = F.regexp_extract("line", LOG_CYCLE, 1)
    marked = lines.select(
        "file",
        "line",
        "line_order",
        F.when(found != "", F.struct("line_order", found.cast("int").alias("cycle"))).alias("mark"),
    )
    carried = running(
        marked, ["file"], ["line_order"], {"at": Running(F.col("mark"), kind="max", span="upto")}
    )

    def number(pattern, group, kind="double"):
        text = F.regexp_extract("line", pattern, group)
        return F.max(F.when(text != "", text.try_cast(kind)))

    per_cycle = (
        carried.where(F.col("at").isNotNull())
        .groupBy("file", F.col("at.cycle").alias("iteration"))
        .agg(
            number(LOG_W2, 1).alias("w2_before"),
            number(LOG_W2, 2).alias("w2"),
            number(LOG_W2, 3).alias("ll_after_w2"),
            number(LOG_BETA, 1).alias("beta_before"),
            number(LOG_BETA, 2).alias("beta"),
            number(LOG_BETA, 3).alias("ll_after_beta"),
            number(LOG_CLASS, 1, "bigint").alias("correct"),
            number(LOG_CLASS, 2, "bigint").alias("valid_votes"),
            number(LOG_CLASS, 3).alias("classification_pct"),
        )
    )
    return per_cycle.withColumn(
        "log_likelihood", F.coalesce("ll_after_beta", "ll_after_w2")
    )


def read_optimizer_trace(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.audit import TRACE_COLUMNS, require_columns

    return require_columns(spark.read.parquet(path), TRACE_COLUMNS)
