"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SKIP = {"pipeline"}
#: What the smallest tables may have none of.
RARE = {"anomaly_token_spikes"}
NAMES = [n for n in entry.queries() if n not in SKIP and not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or not hasattr(v, "__len__") and pd.isna(v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if":
            return float(f"{float(v):.9g}")
        return str(v)

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert list(got.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) or name in RARE, "a query without rows proves nothing"
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_as_of_join_probes_every_event(spark):
    """The whole as-of join has one row per event."""
    assert entry.queries()["as_of_join"](spark, DATA).count() == spark.read.parquet(f"{DATA}/events.parquet").count()
