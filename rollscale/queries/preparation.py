"""Recoding, screens, placements, seeds and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import votes as V
from ..operators import audit, compare, running, screens, seeds, scoring
from ..session import scratch_path
from ..sources import sinks
from .catalog import query


@query(
    "legislator_id:l period:i rollcall_id:l code:i vote:i",
    "SELECT legislator_id, period, rollcall_id, code, CAST(vote AS INTEGER) AS vote FROM votes",
)
def vote_recode(p):
    return p.votes


@query(
    "flagnum:l observed:l cells:l",
    """SELECT l_linenumber AS flagnum,
  count(*) FILTER (WHERE try_cast(trim(cell) AS DOUBLE) BETWEEN 1.0 AND 6.0) AS observed,
  count(*) AS cells
FROM (SELECT l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN ' ' || l_linenumber || ' '
  WHEN 1 THEN l_returnflag ELSE CAST(l_quantity AS VARCHAR) END AS cell FROM lineitem)
GROUP BY 1""",
)
def observed_flag(p):
    line = p.table("lineitem")
    n = F.col("l_linenumber")
    cell = (
        F.when(n % 3 == 0, F.concat(F.lit(" "), n.cast("string"), F.lit(" ")))
        .when(n % 3 == 1, F.col("l_returnflag"))
        .otherwise(F.col("l_quantity").cast("string"))
    )
    return line.groupBy(n.alias("flagnum")).agg(
        F.count_if(V.is_observed_cell(cell)).alias("observed"), F.count("*").alias("cells")
    )


@query(
    "cell_kind:s cells:l missing:l total:d",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'token' ELSE 'number' END AS cell_kind,
  count(*) AS cells, count(*) FILTER (WHERE value IS NULL) AS missing,
  sum(coalesce(value, -1.0)) AS total
FROM (SELECT l_returnflag, try_cast(nullif(CASE WHEN cell IN ('NA','na','N/A','NaN','nan','') THEN NULL
    ELSE cell END, '') AS DOUBLE) AS value
  FROM (SELECT l_returnflag, trim(CASE l_returnflag WHEN 'A' THEN l_linestatus || 'x'
    WHEN 'N' THEN (CASE l_linenumber % 4 WHEN 0 THEN ' NA ' WHEN 1 THEN 'nan'
      WHEN 2 THEN '' ELSE 'N/A' END)
    ELSE CAST(l_linenumber AS VARCHAR) END) AS cell FROM lineitem))
GROUP BY 1""",
)
def na_tokens(p):
    line = p.table("lineitem")
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    token = (
        F.when(n % 4 == 0, " NA ").when(n % 4 == 1, "nan").when(n % 4 == 2, "").otherwise("N/A")
    )
    cell = (
        F.when(flag == "A", F.concat("l_linestatus", F.lit("x")))
        .when(flag == "N", token)
        .otherwise(n.cast("string"))
    )
    kind = F.when(flag == "A", "text").when(flag == "N", "token").otherwise("number")
    return line.groupBy(kind.alias("cell_kind")).agg(
        F.count("*").alias("cells"),
        F.count_if(V.parse_double(cell).isNull()).alias("missing"),
        F.sum(V.parse_double(cell, -1.0)).alias("total"),
    )


@query(
    "code:i cells:l",
    "SELECT code, count(*) AS cells FROM cells GROUP BY code",
)
def code_frequency(p):
    return p.cells.groupBy("code").agg(F.count("*").alias("cells"))


@query(
    "legislator_id:l period:i rollcall_id:l code:i",
    """SELECT legislator_id, period, rollcall_id, CASE WHEN vote IS NULL THEN 9 ELSE code END AS code
FROM votes SEMI JOIN placements USING (legislator_id, period)""",
)
def absent_kept(p):
    from ..operators.cuts import floor_cloud

    return floor_cloud(p.votes, p.placements)


@query(
    "legislator_id:l x1:d x2:d",
    """SELECT s_suppkey + 1 AS legislator_id,
  round_even(s_acctbal * 0.0001::DOUBLE * 1000.0, 0) / 1000.0 AS x1,
  round_even(s_suppkey * 0.0005::DOUBLE * 1000.0, 0) / 1000.0 AS x2 FROM supplier""",
)
def round_starts(p):
    return p.table("supplier").select(
        (F.col("s_suppkey") + 1).alias("legislator_id"),
        V.round_start(F.col("s_acctbal") * 0.0001).alias("x1"),
        V.round_start(F.col("s_suppkey") * 0.0005).alias("x2"),
    )


@query(
    "legislator_id:l party_name:s report_name:s",
    """SELECT legislator_id, CASE party WHEN 100 THEN 'D' WHEN 200 THEN 'R' ELSE 'I' END AS party_name,
  CASE party WHEN 100 THEN 'D' WHEN 200 THEN 'R' ELSE 'I' END AS report_name FROM roster""",
)
def party_label(p):
    return p.roster.select(
        "legislator_id",
        V.party_label(F.col("party")).alias("party_name"),
        F.coalesce(V.party_label(F.col("party"), independent=328), F.lit("I")).alias("report_name"),
    )


@query(
    "legislator_id:l region:i",
    """SELECT legislator_id, CAST(state BETWEEN 40 AND 49 OR state IN (51, 53, 54) AS INTEGER) AS region
FROM roster""",
)
def region_flag(p):
    return p.roster.select("legislator_id", V.in_region(F.col("state")).alias("region"))


@query(
    "legislator_id:l label:s party_score:d",
    """SELECT legislator_id, label, coalesce(s.score, 0.0) AS party_score
FROM (SELECT legislator_id, CASE party WHEN 100 THEN 'PS' WHEN 200 THEN 'RN' ELSE 'XX' END AS label
  FROM roster) LEFT JOIN (VALUES ('PS', -0.6), ('RN', 0.75)) AS s(label, score) USING (label)""",
)
def party_score(p):
    label = F.when(F.col("party") == 100, "PS").when(F.col("party") == 200, "RN").otherwise("XX")
    return compare.with_party_score(
        p.roster.select("legislator_id", label.alias("party"))
    ).withColumnRenamed("party", "label")


@query(
    "congress:i party1:i party2:i members:l",
    """SELECT congress, CASE WHEN congress <= 3 THEN 4000 WHEN congress <= 17 THEN 200
    WHEN congress BETWEEN 19 AND 24 THEN 555 WHEN congress BETWEEN 25 AND 30 THEN 100
    WHEN congress >= 35 THEN 100 ELSE 0 END AS party1,
  CASE WHEN congress <= 3 THEN 5000 WHEN congress <= 17 THEN 1
    WHEN congress BETWEEN 19 AND 20 THEN 22 WHEN congress BETWEEN 21 AND 24 THEN 1275
    WHEN congress BETWEEN 25 AND 30 THEN 29 WHEN congress >= 35 THEN 200 ELSE 0 END AS party2,
  count(*) AS members
FROM (SELECT s_suppkey % 40 + 1 AS congress FROM supplier) GROUP BY congress""",
)
def party_era_lookup(p):
    rows = p.table("supplier").select((F.col("s_suppkey") % 40 + 1).cast("int").alias("congress"))
    counted = rows.groupBy("congress").agg(F.count("*").alias("members"))
    return compare.party_era(counted, "congress")


@query(
    "legislator_id:l name:s state:i party:i",
    "SELECT legislator_id, name, state, party FROM roster",
)
def roster_last_wins(p):
    return p.roster


@query(
    "legislator_id:l",
    """SELECT legislator_id FROM cells GROUP BY legislator_id
HAVING bool_or(code NOT IN (-1, 9))""",
)
def phantom_filter(p):
    return screens.roster_members(p.cells)


@query("legislator_id:l period:i", "SELECT legislator_id, period FROM placements")
def placements(p):
    return p.placements


@query(
    "rollcall_id:l period:i yea:l nay:l missing:l total:l minority:l margin:d",
    """SELECT *, yea + nay AS total, least(yea, nay) AS minority,
  CASE WHEN yea + nay > 0 THEN least(yea, nay)::DOUBLE / (yea + nay) ELSE 0.0 END AS margin
FROM margins""",
)
def rollcall_margins(p):
    return p.margins


@query(
    "rollcall_id:l yea:l nay:l",
    """SELECT rollcall_id, yea, nay FROM margins
WHERE yea + nay > 0 AND least(yea, nay)::DOUBLE / (yea + nay) >= 0.025""",
)
def rollcall_screen(p):
    return p.margins.where(screens.passes_margin())


@query(
    "rollcall_id:l d1:d d2:d nonzero:i",
    """SELECT rollcall_id, d1, d2, CAST(abs(d1) > 1e-10 OR abs(d2) > 1e-10 AS INTEGER) AS nonzero
FROM (SELECT rollcall_id, CASE WHEN valid THEN d1 ELSE 0.0 END AS d1,
  CASE WHEN valid THEN d2 ELSE 0.0 END AS d2 FROM bills)""",
)
def nonzero_spread(p):
    return screens.zero_invalid(p.bills).withColumn("nonzero", screens.has_spread())


@query(
    "rollcall_id:l z1:d z2:d d1:d d2:d valid:i",
    """SELECT rollcall_id, CASE WHEN valid THEN z1 ELSE 0.0 END AS z1,
  CASE WHEN valid THEN z2 ELSE 0.0 END AS z2, CASE WHEN valid THEN d1 ELSE 0.0 END AS d1,
  CASE WHEN valid THEN d2 ELSE 0.0 END AS d2, CAST(valid AS INTEGER) AS valid FROM bills""",
)
def zero_invalid(p):
    return screens.zero_invalid(p.bills)


@query(
    "period:i votes:l yeas:l",
    "SELECT period, count(*) AS votes, count(*) FILTER (WHERE vote) AS yeas FROM valid_votes GROUP BY period",
)
def drop_missing(p):
    return p.valid_votes.groupBy("period").agg(
        F.count("*").alias("votes"), F.count_if("vote").alias("yeas")
    )


@query(
    "legislator_id:l votes:l",
    """SELECT legislator_id, count(*) AS votes FROM valid_votes GROUP BY legislator_id
HAVING count(*) >= 25""",
)
def min_votes(p):
    return screens.min_participation(p.votes)


@query(
    "legislator_id:l votes:l",
    """SELECT legislator_id, count(*) AS votes FROM cells
WHERE legislator_id IN (SELECT s_suppkey + 1 FROM supplier WHERE s_nationkey <= 12)
GROUP BY legislator_id""",
)
def chamber_semi_join(p):
    chamber = p.table("supplier").where("s_nationkey <= 12").select(
        (F.col("s_suppkey") + 1).alias("legislator_id")
    )
    return screens.keep_members(p.cells, chamber).groupBy("legislator_id").agg(
        F.count("*").alias("votes")
    )


@query(
    "period:i cells:l",
    "SELECT period, count(*) AS cells FROM cells WHERE period BETWEEN 2 AND 5 GROUP BY period",
)
def period_range(p):
    return screens.period_range(p.cells, 2, 5).groupBy("period").agg(F.count("*").alias("cells"))


@query(
    "iteration:i block:s outcome:s blocks:l",
    """SELECT iteration, block, CASE WHEN NOT attempted THEN 'skipped' WHEN accepted THEN 'accepted'
  ELSE 'rejected' END AS outcome, count(*) AS blocks FROM optimizer_trace GROUP BY 1, 2, 3""",
)
def trace_attempts(p):
    return (
        screens.attempted_rows(p.optimizer_trace)
        .groupBy("iteration", "block", "outcome")
        .agg(F.count("*").alias("blocks"))
    )


@query(
    "legislator_id:l period:i coord1D:d coord2D:d",
    """SELECT legislator_id, period, x1 AS coord1D, x2 AS coord2D FROM seeded
WHERE abs(x1) > 1e-10 OR abs(x2) > 1e-10""",
)
def drop_origin(p):
    seeded = seeds.assign(p.placements, p.seeds_member, p.seeds_period)
    return screens.drop_origin(seeded.withColumnsRenamed({"x1": "coord1D", "x2": "coord2D"}))


@query(
    "legislator_id:l period:i x1:d x2:d provenance:s",
    "SELECT * FROM seeded",
)
def seed_coalesce(p):
    return seeds.assign(p.placements, p.seeds_member, p.seeds_period)


@query(
    "provenance:s placements:l",
    "SELECT provenance, count(*) AS placements FROM seeded GROUP BY provenance",
)
def seed_coverage(p):
    return seeds.coverage(seeds.assign(p.placements, p.seeds_member, p.seeds_period))


@query(
    "legislator_id:l x1:d x2:d",
    """SELECT legislator_id, k::DOUBLE / n - 0.5 AS x1,
  k::DOUBLE / n * (CASE WHEN k % 2 = 0 THEN 0.1 ELSE -0.1 END::DOUBLE) AS x2
FROM (SELECT legislator_id, row_number() OVER (ORDER BY legislator_id) - 1 AS k,
  count(*) OVER () AS n FROM (SELECT DISTINCT legislator_id FROM placements))""",
)
def seed_ramp(p):
    return seeds.ramp(p.placements.select("legislator_id").distinct())


@query(
    "period:i n_rollcalls:l rc_offset:l",
    """SELECT period, n AS n_rollcalls, coalesce(sum(n) OVER (ORDER BY period
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rc_offset
FROM (SELECT period, count(*) AS n FROM margins GROUP BY period)""",
)
def period_offsets(p):
    return seeds.period_offsets(p.margins)


@query(
    "rollcall_id:l period:i local_id:l",
    """SELECT rollcall_id, period, row_number() OVER (PARTITION BY period ORDER BY rollcall_id) AS local_id
FROM margins""",
)
def local_bill_ids(p):
    return sinks.local_ids(p.margins)


@query(
    "session:i ID:l rollcall_id:l",
    """WITH offs AS (SELECT period, n, coalesce(sum(n) OVER (ORDER BY period
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT period, count(*) AS n FROM margins GROUP BY period)),
starts AS (SELECT period AS session, rollcall_id - (period - 1) * 200 - 2 AS "ID" FROM margins)
SELECT session, "ID", off + "ID" - 1 AS rollcall_id FROM starts JOIN offs ON session = period
WHERE "ID" BETWEEN 1 AND n""",
)
def bill_id_mapping(p):
    starts = p.margins.select(
        F.col("period").alias("session"),
        (F.col("rollcall_id") - (F.col("period") - 1) * 200 - 2).alias("ID"),
    )
    return seeds.bill_ids(starts, seeds.period_offsets(p.margins))


@query(
    "legislator_id:l rollcall_id:l v1:i v2:i",
    """SELECT legislator_id, rollcall_id, CAST(vote AS INTEGER) AS v1, CAST(w AS INTEGER) AS v2 FROM (
  SELECT legislator_id, rollcall_id, vote,
    CASE WHEN rollcall_id % 97 = 5 AND code = 1 THEN false WHEN code = 8 THEN true ELSE vote END AS w
  FROM votes) WHERE vote IS DISTINCT FROM w""",
)
def layout_consistency(p):
    changed = (
        F.when((F.col("rollcall_id") % 97 == 5) & (F.col("code") == 1), F.lit(False))
        .when(F.col("code") == 8, F.lit(True))
        .otherwise(F.col("vote"))
    )
    return audit.layout_mismatches(p.votes, p.votes.withColumn("vote", changed))


@query(
    "unmatched:l state_differs:l party_differs:l",
    """SELECT count(*) FILTER (WHERE a.legislator_id IS NULL OR b.legislator_id IS NULL) AS unmatched,
  0 AS state_differs,
  count(*) FILTER (WHERE a.party IS DISTINCT FROM b.party AND a.legislator_id IS NOT NULL
    AND b.legislator_id IS NOT NULL) AS party_differs
FROM (SELECT * FROM roster_rows WHERE file_order = 1) a
FULL JOIN (SELECT * FROM roster_rows WHERE file_order = 2) b USING (legislator_id)""",
)
def record_agreement(p):
    rows = p.roster_rows
    return audit.record_mismatches(
        rows.where("file_order = 1"),
        rows.where("file_order = 2"),
        ["legislator_id"],
        ["state", "party"],
    )


@query(
    "members:l placements:l multi_period_members:l",
    """SELECT count(*) AS members, sum(n) AS placements, count(*) FILTER (WHERE n > 1) AS multi_period_members
FROM (SELECT legislator_id, count(*) AS n FROM placements GROUP BY legislator_id)""",
)
def presence_report(p):
    return audit.presence(p.placements)


@query(
    "period:i vote_records:l members:l roll_calls:l roster:l matrix_cells:l",
    """SELECT period, count(*) AS vote_records, count(DISTINCT legislator_id) AS members,
  count(DISTINCT rollcall_id) AS roll_calls, (SELECT count(*) FROM supplier) AS roster,
  (SELECT count(*) FROM supplier) * count(DISTINCT rollcall_id) AS matrix_cells
FROM cells GROUP BY period""",
)
def input_shape(p):
    return compare.input_shape(p.cells, p.table("supplier"))


@query(
    "active_members:l members_below_25_votes:l share_below_25_votes:d roll_calls:l median_votes:d",
    """WITH c AS (SELECT legislator_id, count(*) AS n FROM valid_votes GROUP BY 1)
SELECT count(*) AS active_members, count(*) FILTER (WHERE n < 25) AS members_below_25_votes,
  count(*) FILTER (WHERE n < 25)::DOUBLE / greatest(count(*), 1) AS share_below_25_votes,
  (SELECT count(DISTINCT rollcall_id) FROM votes) AS roll_calls, median(n) AS median_votes FROM c""",
)
def input_profile(p):
    return compare.input_profile(p.votes)


@query(
    "period:i cells:l",
    "SELECT period, count(*) AS cells FROM cells GROUP BY period",
)
def union_periods(p):
    """One read of all period folders, however many there are."""
    path = scratch_path(p.spark, "period-cells")
    p.cells.write.partitionBy("period").parquet(path)
    whole = p.spark.read.schema(p.cells.schema).parquet(path)
    return whole.groupBy("period").agg(F.count("*").alias("cells"))


@query(
    "lines:l repeated_lines:l cells:l",
    """SELECT (SELECT count(*) FROM lineitem) AS lines,
  (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM cells) AS repeated_lines,
  (SELECT count(*) FROM cells) AS cells""",
)
def panel_coverage(p):
    """Lines that the cells are made of, and how many of them share a cell with another."""
    return p.records.agg(
        F.sum("lines").alias("lines"),
        F.sum(F.col("lines") - 1).alias("repeated_lines"),
        F.count("*").alias("cells"),
    )


@query(
    "legislator_id:l",
    """SELECT legislator_id FROM cells WHERE period <= 3 UNION
SELECT legislator_id FROM cells WHERE period > 3""",
)
def global_roster(p):
    early = p.cells.where("period <= 3").select("legislator_id")
    return early.union(p.cells.where("period > 3").select("legislator_id")).distinct()


@query(
    "legislator_id:l",
    """SELECT legislator_id FROM placements GROUP BY legislator_id
HAVING count(*) = (SELECT count(DISTINCT period) FROM placements)""",
)
def always_present(p):
    return compare.always_present(p.placements)


@query(
    "legislator_id:l party:i",
    "SELECT legislator_id, party FROM roster",
)
def party_map_union(p):
    rows = p.roster_rows.select("legislator_id", "party", "file_order")
    both = rows.where("file_order = 1").unionByName(rows.where("file_order = 2"))
    return screens.last_wins(both, ["legislator_id"], "file_order")


@query(
    "legislator_id:l period:i side:s",
    """WITH a AS (SELECT legislator_id, period FROM placements),
b AS (SELECT legislator_id, CASE WHEN legislator_id % 11 = 0 THEN period + 10 ELSE period END AS period
  FROM placements)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def key_set_diff(p):
    moved = F.when(F.col("legislator_id") % 11 == 0, F.col("period") + 10).otherwise(
        F.col("period")
    )
    return compare.key_difference(p.placements, p.placements.withColumn("period", moved))


@query(
    "rollcall_id:l yea:l yea_p1:l yea_p1_in:l yea_p1_out:l yea_p2:l yea_p2_in:l yea_p2_out:l "
    "nay:l nay_p1:l nay_p1_in:l nay_p1_out:l nay_p2:l nay_p2_in:l nay_p2_out:l missing:l",
    "WITH v AS (SELECT votes.*, party, state BETWEEN 40 AND 49 OR state IN (51, 53, 54) AS r"
    " FROM votes LEFT JOIN roster USING (legislator_id)) SELECT rollcall_id, "
    + ", ".join(
        f"count(*) FILTER (WHERE {cond}) AS {name}"
        for side, cond0 in (("yea", "vote"), ("nay", "NOT vote"))
        for name, cond in (
            [(side, cond0)]
            + [
                (f"{side}_{pn}{suffix}", f"{cond0} AND party = {code}{extra}")
                for pn, code in (("p1", 100), ("p2", 200))
                for suffix, extra in (("", ""), ("_in", " AND r"), ("_out", " AND NOT r"))
            ]
        )
    )
    + ", count(*) FILTER (WHERE vote IS NULL) AS missing FROM v GROUP BY rollcall_id",
)
def party_crosstab(p):
    return scoring.party_crosstab(p.votes, p.roster, (100, 200))


@query(
    "party:i region:i yea:l nay:l",
    """SELECT party, CAST(r AS INTEGER) AS region, count(*) FILTER (WHERE vote) AS yea,
  count(*) FILTER (WHERE NOT vote) AS nay
FROM (SELECT v.vote, party, state BETWEEN 40 AND 49 OR state IN (51, 53, 54) AS r
  FROM valid_votes v JOIN roster USING (legislator_id)) GROUP BY ROLLUP (party, r)""",
)
def party_region_rollup(p):
    return scoring.party_region_rollup(p.votes, p.roster)
