import pytest
from pyspark.sql import functions as F

from rollscale.sources import matrices, sinks, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_matrix_with_quotes_tokens_and_repeated_members(spark, tmp_path):
    write(tmp_path / "votes_matrix_p1.csv", '"","a","b"\n"7",1,NA\n8,x,6\n7,9,\n')
    write(tmp_path / "votes_matrix_p3.csv", ",c\n7,2\n")
    got = matrices.read_vote_matrices(spark, str(tmp_path))
    rows = sorted(
        (r["legislator_id"], r["period"], r["local_rc"], r["rollcall_key"], r["code"]) for r in got.collect()
    )
    assert rows == [
        (7, 1, 1, "a", 9),
        (7, 1, 2, "b", -1),
        (7, 3, 1, "c", 2),
        (8, 1, 1, "a", -1),
        (8, 1, 2, "b", 6),
    ]
    assert sorted(r[0] for r in matrices.periods_found(spark, str(tmp_path)).collect()) == [1, 3]
    ids = matrices.global_ids(got).select("period", "local_rc", "rollcall_id").distinct()
    assert sorted(tuple(r) for r in ids.collect()) == [(1, 1, 0), (1, 2, 1), (3, 1, 2)]


def test_single_matrix_is_period_one(spark, tmp_path):
    write(tmp_path / "votes_matrix.csv", ",a\n7,1\n")
    got = matrices.read_vote_matrices(spark, str(tmp_path)).collect()
    assert [(r["period"], r["code"]) for r in got] == [(1, 1)]


def test_roster_and_seeds(spark, tmp_path):
    path = write(
        tmp_path / "roster.csv",
        'legislator_id,id,name,party,region,district\n1,1,"Doe, J",A,r,d\n0,0,x,A,r,d\n1,1,Late,B,r,d\nx,1,x,A,r,d\n',
    )
    rows = tables.read_roster(spark, path).collect()
    assert [(r["legislator_id"], r["name"], r["party"]) for r in rows] == [(1, "Late", "B")]
    thin = write(tmp_path / "thin.csv", "legislator_id,party,name\n1,A,x\n")
    with pytest.raises(ValueError):
        tables.read_roster(spark, thin)
    seeds = write(
        tmp_path / "seeds.csv",
        "coord1D,coord2D,legislator_id,legislator_name,party\n0.5,bad,1,nan,A\nNA,0.2,2,nan,A\n0.1,0.1,-3,nan,A\n",
    )
    got = sorted(tuple(r) for r in tables.read_member_seeds(spark, seeds).collect())
    assert got == [(1, 0.5, 0.0), (2, 0.0, 0.2)]
    period = write(
        tmp_path / "period.csv", "legislator_id,period,coord1D,coord2D\n1,1,0.5,0.1\n1,0,0.5,0.1\nx,2,0,0\n"
    )
    assert tables.read_period_seeds(spark, period).count() == 1
    assert tables.rejected_period_seeds(spark, period).count() == 2


def test_bill_params_and_required_columns(spark, tmp_path):
    path = write(
        tmp_path / "bills.csv",
        '"session","ID",midpoint1D,midpoint2D,spread1D,spread2D\n1,1,0.1,0.2,0.3,0.4\n1,2,NA,0.2,0.3,0.4\n',
    )
    got = sorted((r["ID"], r["given"]) for r in tables.read_bill_params(spark, path).collect())
    assert got == [(1, 1), (2, 0)]
    bad = write(tmp_path / "bad.csv", "legislator_id,period\n1,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_coordinates(spark, bad)


def test_run_log(spark, tmp_path):
    path = write(
        tmp_path / "run.log",
        "start\n[WINT] W2: 9 -> 9, LL: -9\n=== Iteracion global 1 ===\n[WINT] W2: 0.3 -> 0.31, LL: -10.5\n"
        "[SIGMAS] Beta: 5.0 -> 5.1, LL: -9.5\nClasificacion: 8/10 (80.00%)\n[TIMING iter 1]\n"
        "=== Iteracion global 2 ===\n[WINT] W2: 0.31 -> 0.32, LL: -9.0\n",
    )
    rows = tables.read_run_log(spark, path).orderBy("iteration").collect()
    assert [r["iteration"] for r in rows] == [1, 2]
    assert rows[0]["w2"] == 0.31 and rows[0]["log_likelihood"] == -9.5 and rows[0]["correct"] == 8
    assert rows[1]["beta"] is None and rows[1]["log_likelihood"] == -9.0


def test_fixed_width_records(spark, tmp_path):
    starts = write(tmp_path / "starts.dat", "  1    7  0.300 -0.100  0.200  0.050\n")
    r = matrices.read_fixed_width(spark, starts, matrices.ITEM_STARTS).first()
    assert (r["period"], r["number"], r["spread1"], r["mid1"], r["spread2"], r["mid2"]) == (
        1, 7, 0.3, -0.1, 0.2, 0.05,
    )
    member = f"{1:4d}{23:6d}{41:3d}{2:2d} {'STATE':7s} {100:4d} {'NAME':11s}{0.25:7.3f}{-0.5:7.3f}\n"
    r = matrices.read_fixed_width(
        spark, write(tmp_path / "members.dat", member), matrices.MEMBER_STARTS
    ).first()
    assert (r["legislator_id"], r["state"], r["party"], r["x1"], r["x2"]) == (23, 41, 100, 0.25, -0.5)
    transposed = write(tmp_path / "votes.dat", "   1    7 169\n")
    rows = matrices.read_fixed_width_votes(
        spark, transposed, matrices.ITEM_VOTES_PREFIX, matrices.ITEM_VOTES_START
    ).collect()
    assert [(r["number"], r["slot"], r["code"]) for r in rows] == [(7, 1, 1), (7, 2, 6), (7, 3, 9)]


def test_summary_round_trip(spark, tmp_path):
    row = spark.createDataFrame([(-1.5, 10, 0.5, 6.0)], "log_likelihood double, valid_votes bigint, w2 double, beta double")
    path = sinks.write_csv(sinks.summary(row), str(tmp_path / "summary"))
    got = tables.read_summary(spark, path).first()
    assert got["log_likelihood"] == -1.5 and got["valid_votes"] == 10 and got["beta"] == 6.0
    with pytest.raises(Exception):
        sinks.write_csv(row, path)


def test_report_json(spark):
    df = spark.createDataFrame([(2, 1)], "b int, a int")
    r = sinks.report_json(("panel", df)).first()
    assert (r["section"], r["document"]) == ("panel", '{"a":1,"b":2}')


def test_optimizer_trace_needs_its_columns(spark, tmp_path):
    path = str(tmp_path / "trace")
    spark.range(1).select(F.lit(1).alias("attempted")).write.parquet(path)
    with pytest.raises(ValueError):
        tables.read_optimizer_trace(spark, path)


def test_matrix_cells_with_quotes_and_decimals(spark, tmp_path):
    from rollscale.sources import matrices

    (tmp_path / "votes_matrix_p2.csv").write_text(
        'id,"Ley 1, art 2",rc2,"a ""b"", c"\n7,6.0,1x,\n8,"9",x,-1\n'
    )
    rows = matrices.read_vote_matrices(spark, str(tmp_path)).collect()
    got = {(r.legislator_id, r.local_rc): (r.rollcall_key, r.code) for r in rows}
    assert got[7, 1] == ("Ley 1, art 2", 6) and got[7, 2] == ("rc2", 1) and got[7, 3][1] == -1
    assert got[8, 1][1] == 9 and got[8, 2][1] == -1 and got[8, 3][1] == -1
    assert [r.period for r in matrices.periods_found(spark, str(tmp_path)).collect()] == [2]


def test_fixed_width_votes_have_no_length_limit(spark, tmp_path):
    from rollscale.sources import matrices

    (tmp_path / "wide.txt").write_text("  7" + "16" * 600_000 + "\n")
    votes = matrices.read_fixed_width_votes(spark, str(tmp_path), [("member", 1, 3, "int")], 4)
    assert votes.count() == 1_200_000


def test_wide_lines_fill_gaps(spark):
    cells = spark.createDataFrame(
        [(1, 1, 2, 6), (1, 1, 4, 1), (2, 1, 1, 3), (2, 2, 5, None)],
        "legislator_id long, period int, local_rc long, code int",
    )
    lines = sinks.wide_matrix_lines(cells, 5).where("NOT line LIKE ',%'").collect()
    assert sorted((r.period, r.line) for r in lines) == [
        (1, "1,9,6,9,1,9"), (1, "2,3,9,9,9,9"), (2, "2,9,9,9,9,9"),
    ]
    roster = spark.createDataFrame([(1,), (2,), (3,)], "legislator_id long")
    rows = sinks.padded_rows(cells, roster, 2, 5).collect()
    assert {(r.legislator_id, r.period): r.line for r in rows} == {
        (1, 1): "96919", (1, 2): "99999", (2, 1): "39999",
        (2, 2): "99999", (3, 1): "99999", (3, 2): "99999",
    }


@pytest.mark.parametrize("row", [(1, 1, 6, 1), (1, 1, 0, 1), (1, 1, 2, 1), (1, 3, 1, 1)])
def test_cells_outside_the_matrix_raise(spark, row):
    cells = spark.createDataFrame(
        [(1, 1, 2, 6), row], "legislator_id long, period int, local_rc long, code int"
    )
    roster = spark.createDataFrame([(1,)], "legislator_id long")
    with pytest.raises(Exception, match="outside"):
        sinks.padded_rows(cells, roster, 2, 5).collect()
