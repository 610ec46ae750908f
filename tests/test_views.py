"""Each application view equals its SQL text run by DuckDB."""

import math

import duckdb
import pytest

from proselab.sources import views as V
from proselab.sources.tables import DRIVER_TABLES, table_path

from .conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


@pytest.mark.parametrize("name", sorted(V.VIEW_BUILDERS))
def test_view_matches_sql(spark, duck, name):
    df = V.view(spark, SF_SMALL, name)
    cur = duck.execute(V.VIEW_SQL[name])
    cols = [d[0] for d in cur.description]
    assert df.columns == cols
    s = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=repr)
    d = sorted((tuple(_norm(x) for x in r) for r in cur.fetchall()), key=repr)
    assert s == d


def test_user_texts_keeps_the_joined_texts_in_place(spark):
    """the texts joined with their events are not dealt again for the next text."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = V.user_texts(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3
