"""Registered queries over published tables (A8, A9, C1, D1, H5): each makes
the application tables in a folder of its own under the shared checkpoint
folder, changes them there and reads the published version."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import usage as U
from ..session import checkpoint_dir
from ..sources import published as P
from ..sources import views as V
from ..sources.views import with_views
from . import q_changes, q_usage  # noqa: F401 - their SQL is registered first
from .registry import oracle_of, register

#: buckets of the tables made here
BUCKETS = 16


def _store(spark, d, tables, bucketed=False):
    root = f"{checkpoint_dir(spark).rstrip('/')}/proselab-published-{uuid.uuid4().hex[:12]}"
    layouts = {t: x for t, x in P.user_layouts(BUCKETS).items() if t in tables} if bucketed else {}
    store = P.Published(spark, root, {t: P.APP_TABLES[t] for t in tables}, layouts)
    store.create({t: V.view(spark, d, t) for t in tables})
    return store


@register("published_cascade_delete", oracle_of("user_cascade_delete"))
def q_published_cascade_delete(spark, d):
    """H5 as one published version: all admin accounts and their rows."""
    store = _store(spark, d, list(P.APP_TABLES))
    P.delete_users(store, lambda tables: tables["users"].filter(F.col("role") == "admin").select("id"))
    now = store.manifest()
    parts = [store.read(t, now).agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(t).alias("table_name"), "rows_left") for t in sorted(P.APP_TABLES)]
    return reduce(DataFrame.unionByName, parts)


@register(
    "published_append",
    with_views(
        ["login_history", "user_feedback", "user_texts"],
        """
, n AS (SELECT (SELECT max(id) FROM login_history) AS top, (SELECT count(*) FROM user_feedback) AS f, (SELECT count(*) FROM user_texts) AS t)
SELECT 'before' AS part, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first_id, max(id) AS last_id FROM login_history
UNION ALL SELECT 'feedback', f, f, top + 1, top + f FROM n
UNION ALL SELECT 'texts', t, t, top + f + 1, top + f + t FROM n""",
    ),
)
def q_published_append(spark, d):
    """Every feedback, then every text counts as a login; two writers
    append them and the ids go on without a gap."""
    store = _store(spark, d, ["login_history"])
    top = store.manifest()["tables"]["login_history"]["next_id"]
    marks = {"feedback": V.user_feedback(spark, d), "texts": V.user_texts(spark, d)}
    first = {}
    for name, rows in marks.items():
        first[name] = store.manifest()["tables"]["login_history"]["next_id"]
        writer = P.Published(spark, store.root, store.tables)
        writer.append("login_history", rows.select("user_id", F.col("created_at").alias("login_time")))
    part = F.when(F.col("id") < top, "before").when(F.col("id") < first["texts"], "feedback").otherwise("texts")
    out = store.read("login_history").groupBy(part.alias("part"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("bucketed_texts_with_users", oracle_of("texts_with_users"))
def q_bucketed_texts_with_users(spark, d):
    """C1 over tables bucketed on the user: the join needs no exchange."""
    store = _store(spark, d, ["user_texts", "users"], bucketed=True)
    return U.texts_with_users(store.read("user_texts"), store.read("users"))


@register("bucketed_unique_logins", oracle_of("unique_logins"))
def q_bucketed_unique_logins(spark, d):
    """D1 over logins bucketed on the user: users are told apart where they
    are, one count a task goes on."""
    return U.unique_logins(_store(spark, d, ["login_history"], bucketed=True).read("login_history"))
