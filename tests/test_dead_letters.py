"""Retries of dead letters whose sequences meet."""

import duckdb

from tidewright import registry

KINDS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def retried(spark, path, rows):
    table = spark.createDataFrame([(o, p, 1, n, 1.0, 1.0, f, s, None) for o, n, p, f, s in rows], KINDS)
    table.write.parquet(f"{path}/lineitem.parquet")
    got = registry.queries()["queue_dlq_retry"](spark, str(path))
    return sorted(tuple(r[c] for c in ("sequence", "was", "data", "tier")) for r in got.collect())


def test_a_sequence_of_two_workflows(spark, tmp_path):
    # the items of workflows 2 and 3 have one sequence, 3100005; 3 is not to be retried
    rows = [(2, 1, 1_000_005, "R", "F"), (3, 1, 5, "R", "F"), (1, 1, 7, "R", "O"), (4, 1, 9, "R", "F"), (4, 2, 9, "N", "O"), (6, 1, 9, "R", "F")]
    got = retried(spark, tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f"select sequence, was, data, tier from ({registry.oracle_sql()['queue_dlq_retry']})").fetchall()
    assert got == sorted(want) and len(got) == 3


def test_ties_go_by_data(spark, tmp_path):
    rows = [(4, 1, 100_001, "R", "O"), (4, 2, 1, "R", "F"), (4, 1, 100_001, "R", "O"), (1, 1, 1, "R", "F")]
    got = retried(spark, tmp_path, rows)
    assert [(r[0] - 1_000_000_000, r[1], r[2][-4:-2]) for r in got] == [(1, 1_100_001, "RF"), (2, 4_200_001, "RF"), (3, 4_200_001, "RO"), (4, 4_200_001, "RO")]


def test_rows_without_a_part_or_a_flag_come_back_too(spark, tmp_path):
    rows = [(1, 1, None, "R", "F"), (2, 1, 7, None, "F"), (2, 2, 7, "R", None), (4, 1, 7, "R", "O"), (3, 1, None, "R", "F"), (None, 1, 1, "R", "F")]
    got = retried(spark, tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f"select sequence, was, data, tier from ({registry.oracle_sql()['queue_dlq_retry']})").fetchall()
    assert got == sorted(want) and len(got) == 4
