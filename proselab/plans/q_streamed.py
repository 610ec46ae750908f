"""Registered queries over streams (C3, D1): the login table is written into
two sets of files under the shared checkpoint folder, the stream takes in the
first, stops, goes on from its checkpoint with the second, and the kept table
is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import views as V
from ..streaming import login_stream as L
from . import q_usage  # noqa: F401 - its SQL is registered first
from .registry import oracle_of, register


def _kept(spark, d, stream, step):
    root = f"{checkpoint_dir(spark).rstrip('/')}/proselab-streamed-{uuid.uuid4().hex[:12]}"
    logins = V.login_history(spark, d)
    late = F.pmod(F.xxhash64("id"), F.lit(2)) == 1  # both halves are taken in, one after the other
    for part in (logins.filter(late), logins.filter(~F.coalesce(late, F.lit(False)))):
        part.write.mode("append").parquet(f"{root}/logins")
        query = L.keep(stream(L.login_stream(spark, f"{root}/logins")), f"{root}/kept", f"kept-{uuid.uuid4().hex[:8]}", step, f"{root}/stream")
        query.awaitTermination()
    return L.read_kept(spark, f"{root}/kept")


@register("streamed_recent_logins", oracle_of("recent_logins"))
def q_streamed_recent_logins(spark, d):
    """C3 over the append-only table, taken in by two runs of a stream."""
    return _kept(spark, d, lambda s: s, L.latest_logins(lambda session: V.users(session, d)))


@register("streamed_unique_logins", oracle_of("unique_logins"))
def q_streamed_unique_logins(spark, d):
    """D1, exact, over the append-only table, taken in by two runs of a stream."""
    return _kept(spark, d, L.first_logins, L.count_rows)
