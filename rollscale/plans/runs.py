"""Tables of a running fit in shared storage, cycle by cycle.

Fitted roll calls and members stay as the log of all attempts; the state is only kept for the
last cycles.  A cycle counts once its record is written, and a run that was stopped goes on after
its last full cycle.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Cycles whose state is kept: the last one and, while it is replaced, the one before.
KEPT = 2
RECORD = "cycle int, record string"


class RunStore:
    def __init__(self, spark: SparkSession, folder: str | None, settings: str):
        self.spark, self.settings = spark, settings
        self.folder = (folder or scratch_path(spark, "run")).rstrip("/")
        self.records: list[dict] = []
        if folder and self._exists("records"):
            rows = spark.read.schema(RECORD).json(f"{self.folder}/records").collect()
            self.records = [json.loads(r["record"]) for r in sorted(rows, key=lambda r: r["cycle"])]
        if any(r["settings"] != settings for r in self.records):
            raise ValueError(f"{self.folder} holds a run with other settings")

    @property
    def last_cycle(self) -> int:
        return len(self.records)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def write(self, df: DataFrame, name: str, cycle: int) -> DataFrame:
        """Replaces the table of this cycle; what a stopped cycle left is overwritten."""
        path = f"{self.folder}/{name}/cycle={cycle}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, cycle: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/cycle={cycle}")

    def log(self, name: str) -> DataFrame | None:
        """One scan over the tables of all full cycles, with a column `cycle`."""
        if not self._exists(name):
            return None
        return self.spark.read.parquet(f"{self.folder}/{name}").where(F.col("cycle") <= self.last_cycle)

    def finish(self, cycle: int, record: dict) -> None:
        """Marks the cycle as full."""
        record = {**record, "settings": self.settings}
        row = self.spark.createDataFrame([(cycle, json.dumps(record))], RECORD)
        row.coalesce(1).write.mode("append").json(f"{self.folder}/records")
        self.records.append(record)

    def drop_before(self, name: str, cycle: int) -> None:
        """Drops the table that no later cycle reads, once `cycle` is full."""
        path, files = self._path(f"{name}/cycle={cycle - KEPT}")
        files.delete(path, True)
