"""Lines that several documents share (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscale.llm.common import SPACE_CHARS, ascii_lower, body, documents, joined, stored

#: Stands for a missing doc_id: such rows count as one document, after all others.
UNNAMED = 2**63 - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(UNNAMED)).alias("doc"),
        F.xxhash64(body()).alias("print"),
        body().alias("text"),
    )


def line_hashes(docs: DataFrame, shortest: int) -> DataFrame:
    """doc, print, pos and hash of every line whose key has at least `shortest` code points."""
    lines = _named(docs).select("doc", "print", F.posexplode(F.split("text", "\n")))
    keyed = lines.select("doc", "print", "pos", line_key(F.col("col")).alias("key"))
    return keyed.where(F.length("key") >= shortest).select(
        "doc", "print", "pos", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("hash")
    )


def deduplicate(docs: DataFrame, shortest: int = 10, threshold: int = 2) -> DataFrame:
    """doc_id, text (lines that stay), n_lines and n_dropped for every row of docs.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    `shortest` code points in at least `threshold` documents lose their lines outside the smallest
    doc_id that holds them. A null or empty text is one empty line; rows without a doc_id count as
    one document after all others; repeated rows of an id are one document and all are returned;
    a row whose lines all go has an empty text. No rows in, no rows out; other columns are unread.

    Documents are counted by hash after a distinct on (hash, document), so a line of a third of
    all documents is spread until its count; the join that follows has plain exchanges on both
    sides, which adaptive execution splits for such a line.
    """
    hashed = line_hashes(docs, shortest)
    shared = stored(
        hashed.groupBy("hash")
        .agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("owner"))
        .where(F.col("n") >= threshold)
        .select("hash", "owner"),
        "shared-lines",
    )
    drops = (
        joined(hashed, shared, "hash")
        .where("doc <> owner")
        .groupBy("doc", "print")
        .agg(F.collect_set("pos").alias("drops"))
    )
    rows = (
        joined(_named(docs), drops, ["doc", "print"], "left")
        .select("doc", F.split("text", "\n").alias("lines"), "drops")
        .withColumn("n", F.size("lines"))
        .withColumn("every", F.sequence(F.lit(0), F.col("n") - 1))
        .withColumn(
            "stay",
            F.when(F.col("drops").isNull(), F.col("every")).otherwise(
                F.array_except("every", "drops")
            ),
        )
    )
    return rows.select(
        F.nullif(F.col("doc"), F.lit(UNNAMED)).alias("doc_id"),
        F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n").alias("text"),
        F.col("n").cast("long").alias("n_lines"),
        (F.col("n") - F.size("stay")).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT k.doc_id, k.pos, k.line, s.owner IS NOT NULL AND s.owner <> k.doc_id AS gone
  FROM k LEFT JOIN s ON s.key = k.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM m GROUP BY doc_id
"""
