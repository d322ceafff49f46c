"""Every query with an oracle against DuckDB on the smallest tables, and every other one for a stable schema."""

import duckdb
import pytest

from tidewright import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, oracle, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in registry.oracle_sql():
        assert rows
        return
    want = oracle.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
