import duckdb
import pytest

import __spark_entry__ as contract
from catalog import QUERIES
from tools.check_oracles import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry_is_stable(spark):
    df = contract.entry(spark)
    assert df.count() >= 0 and df.columns[-1] == "rank"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(contract.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and df.columns


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    cursor = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())
