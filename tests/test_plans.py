"""Every query with SQL gives the rows that DuckDB gives for the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from hiresift.plans import all_oracles, all_queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def database():
    if not DATA.exists():
        pytest.skip("no test data here")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value).removesuffix(" 00:00:00")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    df = all_queries()[name](spark, str(DATA))
    got = df.collect()
    cursor = database.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    if not DATA.exists():
        pytest.skip("no test data here")
    assert all_queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if DATA.exists():
        assert __spark_entry__.entry(spark).count() > 0
