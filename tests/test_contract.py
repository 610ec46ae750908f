"""Driver contract: entry() smoke, registry shape, and every query with an
oracle equal to DuckDB on the small data set."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from proselab.sources.tables import DRIVER_TABLES, table_path

from .conftest import SF_SMALL


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [r["level"] for r in rows] == ["conservative", "balanced", "creative"]
    assert df.columns == ["level", "rouge1_f_mean", "rouge2_f_mean", "rougeL_f_mean", "count"]


def test_oracles_are_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(dcols)
    s = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=repr)
    idx = [dcols.index(c) for c in order]
    d = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert s == d
