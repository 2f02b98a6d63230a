"""Convergence traces and optimizer logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, convergence
from ..sources import sinks
from .catalog import query

TRACE_COLUMNS = "iteration:l log_likelihood:d"


@query(
    f"{TRACE_COLUMNS} delta_log_likelihood:d",
    """SELECT *, coalesce(log_likelihood - lag(log_likelihood) OVER (ORDER BY iteration), 0.0)
  AS delta_log_likelihood FROM trace""",
)
def trace_delta(p):
    return convergence.deltas(p.trace)


@query(
    f"{TRACE_COLUMNS} ll_average:d classification_average:d",
    """SELECT *, avg(log_likelihood) OVER w AS ll_average, avg(classification_pct) OVER w AS classification_average
FROM trace WINDOW w AS (ORDER BY iteration ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def trace_moving_avg(p):
    return convergence.moving_average(p.trace)


@query(
    "iteration:l delta_w2:d delta_beta:d",
    """SELECT iteration, abs(w2 - lag(w2) OVER (ORDER BY iteration)) AS delta_w2,
  abs(beta - lag(beta) OVER (ORDER BY iteration)) AS delta_beta FROM trace""",
)
def param_change(p):
    return convergence.parameter_changes(p.trace)


@query(
    "iteration:l streak:i stop:i",
    """WITH c AS (SELECT iteration, coalesce(iteration >= 2 AND g >= 0
    AND g <= 40.0 + 0.001 * greatest(1.0, abs(prev)), false) AS calm
  FROM (SELECT *, log_likelihood - lag(log_likelihood) OVER (ORDER BY iteration) AS g,
    lag(log_likelihood) OVER (ORDER BY iteration) AS prev FROM trace)),
i AS (SELECT *, count(*) FILTER (WHERE NOT calm) OVER (ORDER BY iteration) AS island FROM c)
SELECT iteration, s AS streak, CAST(s >= 2 AS INTEGER) AS stop
FROM (SELECT *, count(*) FILTER (WHERE calm) OVER (PARTITION BY island ORDER BY iteration) AS s FROM i)""",
)
def patience_streak(p):
    return convergence.patience(p.trace, 40.0, 0.001)


@query(
    "amplitude:d mean_ll:d relative:d band:s",
    """SELECT *, CASE WHEN relative < 0.001 THEN 'stable' WHEN relative < 0.01 THEN 'limit cycle'
  ELSE 'oscillating' END AS band
FROM (SELECT max(l) - min(l) AS amplitude, avg(l) AS mean_ll, (max(l) - min(l)) / abs(avg(l)) AS relative
  FROM (SELECT log_likelihood AS l FROM trace ORDER BY iteration DESC LIMIT 5))""",
)
def tail_amplitude(p):
    return convergence.tail_amplitude(p.trace)


SEGMENTS = """seg AS (SELECT (iteration - 1) // 15 + 1 AS segment, (iteration - 1) % 15 + 1 AS iteration,
  log_likelihood FROM trace)"""


def _segments(p):
    zero = F.col("iteration") - 1
    return p.trace.select(
        F.floor(zero / 15 + 1).cast("int").alias("segment"),
        (zero % 15 + 1).alias("iteration"),
        "log_likelihood",
    )


@query(
    "segment:i iteration:l log_likelihood:d",
    f"""WITH {SEGMENTS}, o AS (SELECT segment, coalesce(sum(n) OVER (ORDER BY segment
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT segment, count(*) AS n FROM seg GROUP BY 1))
SELECT segment, iteration + off AS iteration, log_likelihood FROM seg JOIN o USING (segment)""",
)
def merge_segments(p):
    return convergence.merge_segments(_segments(p))


@query(
    "segment:i iteration:l log_likelihood:d",
    f"WITH {SEGMENTS} SELECT * FROM seg WHERE segment = (SELECT max(segment) FROM seg)",
)
def final_segment(p):
    return convergence.final_segment(_segments(p))


@query(
    "iterations:l elapsed:d log_likelihood:d",
    f"""WITH {SEGMENTS} SELECT (SELECT count(*) FROM seg) AS iterations,
  (SELECT sum(segment * 1.5) FROM (SELECT DISTINCT segment FROM seg)) AS elapsed,
  (SELECT arg_max(log_likelihood, segment * 1000 + iteration) FROM seg) AS log_likelihood""",
)
def merge_runs(p):
    seg = _segments(p)
    elapsed = seg.select("segment").distinct().select(
        "segment", (F.col("segment") * 1.5).alias("elapsed_seconds")
    )
    return convergence.merged_summary(seg, elapsed)


def _changes_sql(table: str, keys: str, cols: list[str]) -> str:
    over = f"OVER (PARTITION BY {keys} ORDER BY iteration)"
    gaps = [f"abs({c} - lag({c}) {over})" for c in cols]
    g = ", ".join(f"{e} AS g{i}" for i, e in enumerate(gaps))
    names = [f"g{i}" for i in range(len(cols))]
    return f"""WITH d AS (SELECT iteration, {g}, lag(iteration) {over} = iteration - 1 AS seen FROM {table}),
s AS (SELECT iteration, count(*) AS n, count(*) FILTER (WHERE seen) AS m,
  sqrt(sum({' + '.join(f'{x} * {x}' for x in names)}) FILTER (WHERE seen)) AS l2,
  max(greatest({', '.join(names)})) FILTER (WHERE seen) AS largest,
  avg(({' + '.join(names)}) / {len(cols)}) FILTER (WHERE seen) AS mean FROM d GROUP BY 1),
ch AS (SELECT iteration, n AS rows, CASE WHEN ok THEN l2 END AS change_l2,
  CASE WHEN ok THEN largest END AS change_largest, CASE WHEN ok THEN mean END AS change_mean
FROM (SELECT *, coalesce(n = m AND n = lag(n) OVER (ORDER BY iteration), false) AS ok FROM s))"""


CHANGE_COLUMNS = "iteration:i rows:l change_l2:d change_largest:d change_mean:d"
COORD_SQL = _changes_sql("snapshots", "legislator_id, period", ['"coord1D"', '"coord2D"'])


def _coord_changes(p):
    return convergence.snapshot_changes(
        p.snapshots, ["legislator_id", "period"], ["coord1D", "coord2D"]
    )


def _bill_changes(p):
    return convergence.snapshot_changes(
        p.bill_snapshots, ["rollcall_id"], ["z1", "z2", "d1", "d2"]
    )


@query(CHANGE_COLUMNS, COORD_SQL + " SELECT * FROM ch")
def coordinate_change(p):
    return _coord_changes(p)


@query(
    CHANGE_COLUMNS,
    _changes_sql("bill_snapshots", "rollcall_id", ["z1", "z2", "d1", "d2"]) + " SELECT * FROM ch",
)
def bill_change(p):
    return _bill_changes(p)


@query(
    "change_per_member:d relative:d band:s verdict:s",
    COORD_SQL
    + """, t AS (SELECT (max(l) - min(l)) / abs(avg(l)) AS relative
  FROM (SELECT log_likelihood AS l FROM trace ORDER BY iteration DESC LIMIT 5)),
c AS (SELECT change_l2 / rows AS change_per_member FROM ch WHERE change_l2 IS NOT NULL
  ORDER BY iteration DESC LIMIT 1)
SELECT *, CASE WHEN relative < 0.001 THEN 'stable' WHEN relative < 0.01 THEN 'limit cycle'
  ELSE 'oscillating' END AS band, CASE WHEN change_per_member < 0.005 THEN 'converged'
  WHEN change_per_member < 0.02 THEN 'nearly' ELSE 'not converged' END AS verdict FROM c, t""",
)
def convergence_verdict(p):
    return convergence.verdict(_coord_changes(p), convergence.tail_amplitude(p.trace))


ROLLUP = """count(*) FILTER (WHERE attempted) AS attempted_blocks,
  count(*) FILTER (WHERE NOT attempted) AS skipped_blocks, count(*) FILTER (WHERE accepted) AS accepted_blocks,
  count(*) FILTER (WHERE attempted AND NOT accepted) AS rejected_blocks,
  count(*) FILTER (WHERE attempted AND NOT feasible) AS outside_tolerance,
  coalesce(sum(bad_evaluations) FILTER (WHERE attempted), 0) AS infeasible_evaluations,
  max(objective_violation) FILTER (WHERE attempted) AS max_objective_violation,
  max(violation) FILTER (WHERE attempted) AS max_return_violation,
  count(*) FILTER (WHERE corrected) AS corrections, 0 AS accepted_infeasible, 0 AS accepted_decreases"""


@query(
    "iteration:i block:s attempted_blocks:l skipped_blocks:l accepted_blocks:l rejected_blocks:l "
    "outside_tolerance:l infeasible_evaluations:l max_objective_violation:d max_return_violation:d "
    "corrections:l accepted_infeasible:l accepted_decreases:l",
    f"SELECT iteration, block, {ROLLUP} FROM optimizer_trace GROUP BY iteration, block",
)
def trace_rollup(p):
    return audit.trace_rollup(p.optimizer_trace, "iteration", "block")


@query(
    "section:s attempted:l accepted:l",
    """SELECT 'optimizer_contract' AS section, count(*) FILTER (WHERE attempted) AS attempted,
  count(*) FILTER (WHERE accepted) AS accepted FROM optimizer_trace""",
)
def audit_report(p):
    """Verdict document as JSON, read back field by field."""
    document = sinks.report_json(("optimizer_contract", audit.trace_rollup(p.optimizer_trace)))
    fields = F.from_json("document", "attempted_blocks bigint, accepted_blocks bigint")
    return document.select(
        "section",
        fields["attempted_blocks"].alias("attempted"),
        fields["accepted_blocks"].alias("accepted"),
    )
