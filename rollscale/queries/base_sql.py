"""Common table expressions of the panel for the SQL side of the checks."""

from __future__ import annotations

from ..functions.probit import TAIL_P, TAIL_Q


def horner(x: str, coefficients) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def tail_ratio(a: str) -> str:
    return f"({horner(a, TAIL_P)} / {horner(a, TAIL_Q)})"


def log_phi(z: str) -> str:
    """log Phi of an expression already inside [-5, 5]."""
    ratio = tail_ratio(f"abs({z})")
    return (
        f"(CASE WHEN {z} <= 0 THEN -({z}) * ({z}) / 2.0 + ln({ratio}) "
        f"ELSE ln(1.0 - exp(-({z}) * ({z}) / 2.0) * {ratio}) END)"
    )


def phi(z: str) -> str:
    tail = f"(exp(-({z}) * ({z}) / 2.0) * {tail_ratio(f'abs({z})')})"
    return f"(CASE WHEN {z} <= 0 THEN {tail} ELSE 1.0 - {tail} END)"


def scored_from(star: str, w1: float = 1.0, w2: float = 0.25, beta: float = 6.0) -> str:
    """Scoring of a star-shaped relation; w1 and w2 are squared weights."""
    return f"""
SELECT *, {log_phi('zc')} AS ll, abs(u_chosen) <= abs(u_other) AS correct,
  zs < 0 AS gross_error, zs > 0 AS positive
FROM (SELECT *, (e_chosen - e_other) * {beta!r} AS zs,
    greatest(-5.0, least(5.0, (e_chosen - e_other) * {beta!r})) AS zc
  FROM (SELECT *, exp(u_chosen) AS e_chosen, exp(u_other) AS e_other
    FROM (SELECT *,
        CASE WHEN vote THEN -(yes1 * yes1 * {w1!r} + yes2 * yes2 * {w2!r})
             ELSE -(no1 * no1 * {w1!r} + no2 * no2 * {w2!r}) END AS u_chosen,
        CASE WHEN vote THEN -(no1 * no1 * {w1!r} + no2 * no2 * {w2!r})
             ELSE -(yes1 * yes1 * {w1!r} + yes2 * yes2 * {w2!r}) END AS u_other
      FROM (SELECT *, x1 - z1 + d1 AS yes1, x1 - z1 - d1 AS no1,
          x2 - z2 + d2 AS yes2, x2 - z2 - d2 AS no2 FROM ({star})))))"""


BASE = f"""
line AS (
  SELECT l_suppkey AS s, CAST(year(l_shipdate) AS BIGINT) - 1994 AS p,
    l_partkey % 200 AS slot, l_orderkey AS o, l_linenumber AS ln, l_returnflag AS rf
  FROM lineitem),
folded AS (
  SELECT s, p, (p - 1) * 200 + slot AS rc, CAST(sum(o) AS BIGINT) AS o,
    CAST(sum(ln) AS BIGINT) AS ln, bool_and(rf = 'N') AS open_flag
  FROM line GROUP BY s, p, slot),
coded AS (
  SELECT *, ((s * 37) % 101) - 50 + (p - 4) * ((s % 3) - 1) * 2 AS t1,
    ((s * 53) % 97) - 48 AS t2,
    CASE WHEN rc % 10 = 3 THEN -100000 ELSE (((rc * 17) % 81) - 40) * 10 END AS cut,
    CASE WHEN rc % 10 = 3 THEN false ELSE (o * 31 + ln * 7) % 10 = 0 END AS noise,
    p >= s % 3 + 1 AND p <= (CASE s % 4 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 7 END)
      AND NOT (s % 5 = 0 AND p = 4) AS serving
  FROM folded),
cells AS (
  SELECT s + 1 AS legislator_id, CAST(p AS INTEGER) AS period, rc AS rollcall_id,
    rc - (p - 1) * 200 + 1 AS local_rc,
    CAST(CASE WHEN NOT serving OR s % 25 = 24 THEN 9
      WHEN open_flag AND o % 3 = 0
        THEN (CASE ln % 4 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 9 END)
      WHEN ((10 + (rc * 7) % 11) * t1 + ((rc * 13) % 21 - 10) * t2 < cut) <> noise
        THEN 1 + ln % 3
      ELSE 4 + ln % 3 END AS INTEGER) AS code
  FROM coded),
votes AS (
  SELECT *, CASE WHEN code BETWEEN 1 AND 3 THEN true
    WHEN code BETWEEN 4 AND 6 THEN false END AS vote FROM cells),
valid_votes AS (SELECT * FROM votes WHERE vote IS NOT NULL),
placements AS (SELECT DISTINCT legislator_id, period FROM valid_votes),
state AS (
  SELECT legislator_id, period,
    (((legislator_id - 1) * 37) % 101 - 50
      + (period - 4) * ((legislator_id - 1) % 3 - 1) * 2) / 60.0::DOUBLE AS x1,
    (((legislator_id - 1) * 53) % 97 - 48) / 120.0::DOUBLE AS x2
  FROM placements),
margins AS (
  SELECT rollcall_id, period, count(*) FILTER (WHERE vote) AS yea,
    count(*) FILTER (WHERE NOT vote) AS nay,
    count(*) FILTER (WHERE vote IS NULL) AS missing
  FROM votes GROUP BY rollcall_id, period),
planes AS (
  SELECT rollcall_id, period, yea, nay,
    (10 + (rollcall_id * 7) % 11) * 60.0::DOUBLE AS a,
    ((rollcall_id * 13) % 21 - 10) * 120.0::DOUBLE AS b,
    CAST(CASE WHEN rollcall_id % 10 = 3 THEN -100000
      ELSE (((rollcall_id * 17) % 81) - 40) * 10 END AS DOUBLE) AS cut
  FROM margins),
raw_bills AS (
  SELECT rollcall_id, period, yea, nay, cut * a / (a * a + b * b) AS m1,
    cut * b / (a * a + b * b) AS m2, a, b, sqrt(a * a + b * b) AS norm
  FROM planes),
bills AS (
  SELECT rollcall_id, period, yea, nay,
    m1 / greatest(1.0::DOUBLE, sqrt(m1 * m1 + m2 * m2)) AS z1,
    m2 / greatest(1.0::DOUBLE, sqrt(m1 * m1 + m2 * m2)) AS z2,
    a * 0.3::DOUBLE / norm AS d1, b * 0.3::DOUBLE / norm AS d2,
    yea + nay > 0 AND least(yea, nay)::DOUBLE / (yea + nay) >= 0.025::DOUBLE AS valid
  FROM raw_bills),
star AS (
  SELECT v.legislator_id, v.period, v.rollcall_id, v.vote, s.x1, s.x2,
    b.z1, b.z2, b.d1, b.d2
  FROM valid_votes v JOIN state s USING (legislator_id, period)
  JOIN (SELECT * FROM bills WHERE valid) b USING (rollcall_id)),
scored AS ({scored_from('SELECT * FROM star')}),
derived AS (
  SELECT *, sign * ratio * (yes1 * e_yes - no1 * e_no) AS gx1,
    sign * ratio * (yes2 * e_yes - no2 * e_no) * 0.25 AS gx2,
    sign * ratio * (no1 * e_no - yes1 * e_yes) AS gz1,
    sign * ratio * (no2 * e_no - yes2 * e_yes) * 0.25 AS gz2,
    sign * ratio * (yes1 * e_yes + no1 * e_no) AS gd1,
    sign * ratio * (yes2 * e_yes + no2 * e_no) * 0.25 AS gd2
  FROM (SELECT *, exp(-zs * zs / 2.0) / {phi('zc')} AS ratio,
      CASE WHEN vote THEN 1.0 ELSE -1.0 END::DOUBLE AS sign,
      CASE WHEN vote THEN e_chosen ELSE e_other END AS e_yes,
      CASE WHEN vote THEN e_other ELSE e_chosen END AS e_no
    FROM scored)),
fit_a AS (SELECT legislator_id, period, x1 AS "coord1D", x2 AS "coord2D" FROM state),
fit_b AS (
  SELECT legislator_id, period,
    x1 * 0.8::DOUBLE - x2 * 0.6::DOUBLE
      + ((legislator_id * 13 + period * 7) % 11 - 5) / 500.0::DOUBLE AS "coord1D",
    -(x1 * 0.6::DOUBLE + x2 * 0.8::DOUBLE)
      + ((legislator_id * 17 + period * 3) % 13 - 6) / 500.0::DOUBLE AS "coord2D"
  FROM state),
bills_b AS (
  SELECT rollcall_id, period, z1 + (rollcall_id % 7 - 3) / 1000.0::DOUBLE AS z1,
    z2 - (rollcall_id % 5 - 2) / 1000.0::DOUBLE AS z2,
    d1 + (rollcall_id % 3 - 1) / 1000.0::DOUBLE AS d1, d2 FROM bills),
external AS (
  SELECT s_suppkey + 1 AS legislator_id,
    CASE WHEN (s_suppkey + 1) % 10 <> 0
      THEN ((s_suppkey * 37) % 101 - 50) / 55.0::DOUBLE + ((s_suppkey + 1) % 5) / 100.0::DOUBLE
      END AS dim1,
    ((s_suppkey * 53) % 97 - 48) / 110.0::DOUBLE - ((s_suppkey + 1) % 3) / 100.0::DOUBLE AS dim2
  FROM supplier),
roster_rows AS (
  SELECT s_suppkey + 1 AS legislator_id, s_name AS name,
    CAST(s_nationkey + 30 AS INTEGER) AS state,
    CAST(CASE WHEN file_order = 2 AND (s_suppkey + 1) % 6 = 0 THEN 328
      WHEN s_suppkey % 17 = 0 THEN 328
      WHEN (s_suppkey * 37) % 101 - 50 + (s_suppkey % 7) * 4 - 12 < 0 THEN 100
      ELSE 200 END AS INTEGER) AS party, file_order
  FROM supplier, (VALUES (1), (2)) AS f(file_order)),
roster AS (
  SELECT legislator_id, name, state, party FROM (
    SELECT *, row_number() OVER (PARTITION BY legislator_id ORDER BY file_order DESC) AS n
    FROM roster_rows) WHERE n = 1),
seeds_member AS (
  SELECT s_suppkey + 1 AS legislator_id,
    CASE WHEN (s_suppkey + 1) % 9 <> 0
      THEN ((s_suppkey * 37) % 101 - 50) / 60.0::DOUBLE END AS x1,
    CASE WHEN (s_suppkey + 1) % 9 <> 0
      THEN ((s_suppkey * 53) % 97 - 48) / 120.0::DOUBLE END AS x2 FROM supplier),
seeds_period AS (
  SELECT legislator_id, period,
    CASE WHEN legislator_id % 4 = 0 AND period >= 3 THEN x1 END AS x1,
    CASE WHEN legislator_id % 4 = 0 AND period >= 3 THEN x2 END AS x2 FROM state),
seeded AS (
  SELECT p.legislator_id, p.period, coalesce(q.x1, m.x1, 0.0::DOUBLE) AS x1,
    coalesce(q.x2, m.x2, 0.0::DOUBLE) AS x2,
    CASE WHEN q.x1 IS NOT NULL THEN 'period' WHEN m.x1 IS NOT NULL THEN 'member'
      ELSE 'fallback' END AS provenance
  FROM placements p LEFT JOIN seeds_period q USING (legislator_id, period)
  LEFT JOIN seeds_member m USING (legislator_id)),
trace AS (
  SELECT iteration, -(20000.0::DOUBLE / iteration) - yea % 17 AS log_likelihood,
    (nay % 100) / 10.0::DOUBLE + 80.0 AS classification_pct,
    (yea % 23) / 100.0::DOUBLE + 0.3::DOUBLE AS w2, (nay % 31) / 50.0::DOUBLE + 5.0 AS beta,
    yea + nay AS valid_votes, yea AS correct
  FROM (SELECT rollcall_id % 40 + 1 AS iteration, CAST(sum(yea) AS BIGINT) AS yea,
      CAST(sum(nay) AS BIGINT) AS nay FROM margins GROUP BY 1)),
snapshots AS (
  SELECT iteration, legislator_id, period, x1 + move AS "coord1D",
    x2 - move * 0.5::DOUBLE AS "coord2D"
  FROM (SELECT *, ((legislator_id * 7 + iteration * 5 + period) % 9 - 4)
        / (iteration * 100.0::DOUBLE) AS move
    FROM state, (VALUES (1), (2), (3), (4)) AS i(iteration))
  WHERE NOT (iteration = 3 AND period = 7)),
bill_snapshots AS (
  SELECT iteration, rollcall_id, z1 + move AS z1, z2 - move AS z2,
    d1 + move * 0.1::DOUBLE AS d1, d2
  FROM (SELECT *, ((rollcall_id * 3 + iteration * 5) % 7 - 3)
        / (iteration * 100.0::DOUBLE) AS move
    FROM bills, (VALUES (1), (2), (3), (4)) AS i(iteration))),
block_counts AS (
  SELECT period AS iteration, 'rollcall' AS block, rollcall_id AS item_index, yea, nay
  FROM margins
  UNION ALL
  SELECT period, 'legislator', legislator_id, count(*) FILTER (WHERE vote),
    count(*) FILTER (WHERE NOT vote) FROM valid_votes GROUP BY legislator_id, period),
optimizer_trace AS (
  SELECT iteration, block, item_index, (yea + nay) * -0.7::DOUBLE AS initial_log_likelihood,
    (yea + nay) * -0.7::DOUBLE + ((yea * 3 + nay) % 8) / 4.0::DOUBLE AS final_log_likelihood,
    ((yea * 3 + nay) % 8) / 4.0::DOUBLE AS improvement,
    (yea + nay) % 13 + 4 AS objective_evaluations,
    least(yea, nay) > 0 AS attempted,
    least(yea, nay) > 0 AND (yea + nay) % 9 <> 0 AS accepted,
    (least(yea, nay) > 0 AND (yea + nay) % 9 <> 0) OR yea % 2 = 1 AS feasible,
    CASE WHEN (least(yea, nay) > 0 AND (yea + nay) % 9 <> 0) OR yea % 2 = 1 THEN 0.0
      ELSE (yea % 5 + 1) / 1000.0::DOUBLE END AS violation,
    least(yea, nay) > 0 AND (yea + nay) % 9 <> 0 AND yea % 7 = 0 AS corrected,
    nay % 3 AS bad_evaluations, (nay % 3) / 10000.0::DOUBLE AS objective_violation
  FROM block_counts)
"""
