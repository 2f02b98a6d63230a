import pytest
from pyspark.sql import functions as F

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DIRECTORY}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    line = "one shared line of words that is long enough"
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, "", "x"),
        (2, None, "x"),
        (None, words, None),
        (3, words, "y"),
        (3, words, "y"),
        (4, words.replace(" ", "\n\t "), "z"),
        (5, f"{line}\nother text here\n\n{line.upper()} ", "z"),
        (6, f"  {line}\nlast", None),
        (7, "a@b.example.com +1 (555) 123-4567 10.0.0.1 4111 1111 1111 1111 é😀", "x"),
        (8, "word " * 30000, "x"),
        (9, "x" * 50000, "x"),
        (None, None, None),
    ]
    clash = "doc_id long, text string, n_words string"
    return (
        spark.createDataFrame(rows, clash)
        .withColumn("digest", F.lit("d"))
        .withColumn("key", F.lit(1))
        .withColumn("row", F.lit(2))
        .withColumn("batch", F.lit(3))
        .withColumn("n_chars", F.length("text").cast("long"))
    )


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
