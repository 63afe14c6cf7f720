"""Every query against its DuckDB oracle on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tidewire.plans import registry

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{ROOT}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, ROOT)
    rows, columns = df.collect(), sorted(df.columns)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", ["append_new", "append_new_and_keyless"])
def test_pages_that_share_a_url_are_different_pages(spark, tmp_path, name):
    rows = [(i, ["http://a/", "http://b/", None, ""][i // 3 % 4]) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path)).select("page_id", "url").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(registry.ORACLES[name]).fetchall()))


def test_entry_point_without_the_optional_parts(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "_optional", lambda name: None)
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(registry.ORACLES)
