"""Every registered query with SQL gives the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIRECTORY = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
SPARK_TO_ARROW = {
    "bigint": "int64", "int": "int32", "double": "double", "string": "string", "boolean": "bool",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIRECTORY}/{t}.parquet'")
    yield con
    con.close()


def normal(rows, names):
    order = sorted(names)
    out = []
    for r in rows:
        values = []
        for n in order:
            v = r[n]
            missing = v is None or (isinstance(v, float) and math.isnan(v))
            values.append((1, "") if missing else (0, v))
        out.append(tuple(values))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIRECTORY)
    table = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    types = {f.name: SPARK_TO_ARROW[f.dataType.simpleString()] for f in df.schema.fields}
    assert types == {f.name: str(f.type) for f in table.schema}
    got = normal([r.asDict() for r in df.collect()], df.columns)
    assert got == normal(table.to_pylist(), df.columns)


def test_entry_has_one_row(spark):
    assert entry.entry(spark).count() == 1


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
