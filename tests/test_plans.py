"""Plan-shape checks for the scale claims in the README."""

import pytest

import __spark_entry__ as E
from proselab.operators import usage as U
from proselab.sources import views as V

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_products(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_take_ordered(spark):
    plan = _plan(E.queries()["recent_logins"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_lookup_pushed_to_scan(spark):
    plan = _plan(U.user_history(V.user_texts(spark, SF_SMALL), 7))
    assert "EqualTo(user_id,7)" in plan  # reaches the events parquet scan


def test_text_scans_are_pruned(spark):
    plan = _plan(E.queries()["word_route"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
