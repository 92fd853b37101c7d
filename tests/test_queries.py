"""Every query against its SQL, on the smallest tables."""

import os

import __spark_entry__
import duckdb
import pytest

from tessera import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    names = sorted(frame.columns)
    return sorted(repr(tuple(None if v != v else v for v in r)) for r in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not there")
@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_against_sql(spark, name):
    frame = core.QUERIES[name](spark, SF)
    got = frame.toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(core.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
