"""Shared storage, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; a local folder only for a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get(_CONF, None) or sc.getConf().get(_CONF)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rollscale-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor never replays earlier cycles."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_within(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only for a counted size; beyond it Catalyst shuffles."""
    return F.broadcast(df) if rows <= limit else df


def in_scans(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Fewer partitions, of up to `limit` rows, without a shuffle; a task per core at least.

    Every grouping task begins with tens of megabytes of hash table, which costs more than reading
    a small partition.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-rows // limit)))


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of every executor, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_rollscale_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rollscale-py-")) / "rollscale.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._rollscale_shipped = True
