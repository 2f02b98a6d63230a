"""Exact duplicates by a tree of merges over sorted digest runs (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm.common import SPACE, body, documents, joined, stored

FAN_IN = 16
#: A digest with what verifies it: a second hash and the length of the normalised text.
KEY = ["digest", "proof", "size"]


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(body(text), f"{SPACE}+", "")


def digests(docs: DataFrame) -> DataFrame:
    """One row per document; run is the partition whose sorted run holds it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    rows = rows.select("doc_id", F.length("text").alias("chars"), normalised().alias("norm"))
    return rows.select(
        "doc_id",
        "chars",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("proof"),
        F.length("norm").alias("size"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def merge(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: runs of fan_in neighbours meet, each digest keeps its best row and its count."""
    return (
        runs.withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
        .groupBy(*KEY, "run")
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    )


def assign(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row, dropped ones too.

    Texts are equal when equal without white space; a null text is empty. The row with the most
    code points stays, then the smallest doc_id (a null id comes last), then the earliest row, so
    of repeated rows exactly one has kept = true. Empty input gives no rows; other columns of the
    input are not read.

    Rows of a partition first fold into one row per digest; rounds then merge fan_in runs at a
    time until one run per digest is left, so a group of any size sends at most one row per
    partition and no task meets more than fan_in rows of a digest. Results go back down the same
    tree, so a large group is never joined in one task either. Only digests move, never texts.
    """
    rows = stored(digests(docs), "digests")
    best = F.struct(
        (-F.col("chars")).alias("chars"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id"),
        F.col("row"),
    )
    level = stored(
        rows.groupBy(*KEY, "run").agg(F.min(best).alias("best"), F.count("*").alias("n")),
        "digest-runs",
    )
    levels = [level]
    runs = rows.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0] + 1
    while runs > 1:
        level = stored(merge(level, fan_in), "digest-runs")
        levels.append(level)
        runs = -(-runs // fan_in)
    # Down again: a group with one row needs no answer from above.
    found = levels[-1].where("n > 1").select(*KEY, "run", "best", "n")
    for below in reversed(levels[:-1]):
        answer = found.withColumnRenamed("run", "above")
        asks = below.select(*KEY, "run", F.expr(f"run div {fan_in}").cast("int").alias("above"))
        found = joined(asks, answer, [*KEY, "above"]).select(*KEY, "run", "best", "n")
    return joined(rows, found, [*KEY, "run"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id"))
        .otherwise(F.col("best.doc_id"))
        .alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns (see assign for which).

    Of rows that share the id and the text without white space, the longest text stays, then the
    first row. Null and empty texts are one group; a null id is an id like others. Columns of any
    type are kept, maps too; no rows give no rows.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = assign(docs).where("kept").select(ident.alias("id"), F.col("text_sha256").alias("sha"))
    rows = docs.select(
        ident.alias("id"),
        F.sha2(normalised(), 256).alias("sha"),
        F.struct((-F.length(body())).alias("chars"), F.monotonically_increasing_id()).alias("at"),
        F.struct(*docs.columns).alias("row"),
    )
    return (
        joined(rows, kept, ["id", "sha"])
        .groupBy("id", "sha")
        .agg(F.min_by("row", "at").alias("row"))
        .select("row.*")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
