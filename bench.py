"""Wall time of headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

QUERIES = (
    "panel_log_likelihood",
    "confusion",
    "legislator_ll",
    "rollcall_gradient",
    "legislator_gradient",
    "information_matrix",
    "party_crosstab",
    "apre",
    "best_cut_point",
    "cut_errors_by_member",
    "cutting_plane",
    "trajectory_ols",
    "reconstruct_positions",
    "procrustes_period",
    "displacement_stats",
    "spearman",
    "vote_melt",
    "scalar_lattice",
    "fit_rollcalls",
    "fit_rollcalls_constrained",
    "fit_legislators",
    "fit_legislators_constrained",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rollscale-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    from rollscale import queries as catalog
    from rollscale.panel import Panel
    from rollscale.plans import loop
    from rollscale.queries.fits import BASE, START

    times: dict[str, float] = {}

    def clock(name, work):
        began = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - began, 3)

    panel = Panel(spark, directory)
    clock("votes_table", lambda: panel.cells.count())
    runs = catalog.queries()
    for name in QUERIES:
        clock(
            name,
            lambda: runs[name](spark, directory).write.format("noop").mode("overwrite").save(),
        )
    # The published panels are fitted with four cycles.
    for solver in ("line", "constrained"):
        cfg = replace(BASE, solver=solver, cycles=4)
        clock(
            f"fit_4_cycles_{solver}",
            lambda: loop.fit(panel.votes, cfg, START, panel.seeds_member, panel.seeds_period),
        )
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries and two 4-cycle fits",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(directory.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
