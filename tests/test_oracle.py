"""Every registered query of the library against its SQL on the smallest tables, and on tables without rows."""

import decimal
import math

import duckdb
import pytest

from termweave import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{place}/{t}.parquet")
    return str(place)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = sorted(repr(tuple(_plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    rel = duck.sql(plans.ORACLE_SQL[name])
    names = sorted(rel.columns)
    want = sorted(repr(tuple(_plain(r[rel.columns.index(c)]) for c in names)) for r in rel.fetchall())
    assert sorted(df.columns) == names and got == want


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_empty_tables(spark, empty, name):
    plans.QUERIES[name](spark, empty).collect()
