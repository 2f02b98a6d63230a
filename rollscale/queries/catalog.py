"""How a query is registered: a Spark function, typed columns, and SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..panel import Panel
from .base_sql import BASE

_SPARK = {"l": "bigint", "i": "int", "d": "double", "s": "string"}
_SQL = {"l": "BIGINT", "i": "INTEGER", "d": "DOUBLE", "s": "VARCHAR"}
ENTRIES: dict[str, "Entry"] = {}


@dataclass(frozen=True)
class Entry:
    """columns: space-separated name:type, type one of l (bigint), i, d, s."""

    name: str
    build: Callable[[Panel], DataFrame]
    columns: str
    body: str | None
    digits: int

    def typed(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        out = []
        df = self.build(Panel(spark, directory))
        for name, kind in self.typed():
            column = F.col(name).cast(_SPARK[kind])
            if kind == "d":
                column = F.round(column, self.digits) + F.lit(0.0)
            out.append(column.alias(name))
        return df.select(*out)

    def sql(self) -> str:
        out = []
        for name, kind in self.typed():
            text = f"CAST({name} AS {_SQL[kind]})"
            if kind == "d":
                text = f"round({text}, {self.digits}) + 0.0"
            out.append(f"{text} AS {name}")
        return f"WITH {BASE}\nSELECT {', '.join(out)} FROM (\n{self.body}\n) AS q"


def query(columns: str, sql: str | None = None, digits: int = 6, name: str | None = None):
    def register(build: Callable[[Panel], DataFrame]):
        key = name or build.__name__
        if key in ENTRIES:
            raise ValueError(f"duplicate query {key}")
        ENTRIES[key] = Entry(key, build, columns, sql, digits)
        return build

    return register
