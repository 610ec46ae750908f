"""Registered usage-analytics queries (family 1) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from ..sources import views as V
from ..sources.views import with_views
from .ranking import numbered_by_id
from .registry import register


def _r(c, d=6):
    return F.round(F.col(c), d).cast("double").alias(c)


@register(
    "model_usage",
    with_views(
        ["user_texts"],
        """
SELECT model_used, CAST(count(*) AS BIGINT) AS usage_count
FROM user_texts WHERE NOT regexp_matches(model_used, '^[0-9]+$')
GROUP BY model_used ORDER BY usage_count DESC, model_used""",
    ),
)
def q_model_usage(spark, d):
    return U.model_usage(V.user_texts(spark, d))


@register(
    "top_model",
    with_views(
        ["user_texts"],
        """
SELECT coalesce((SELECT model_used FROM user_texts
                 WHERE NOT regexp_matches(model_used, '^[0-9]+$')
                 GROUP BY model_used ORDER BY count(*) DESC, model_used LIMIT 1), 'N/A') AS top_model""",
    ),
)
def q_top_model(spark, d):
    return U.top_model(V.user_texts(spark, d))


@register(
    "unique_logins",
    with_views(["login_history"], "SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS unique_users FROM login_history"),
)
def q_unique_logins(spark, d):
    return U.unique_logins(V.login_history(spark, d))


@register(
    "text_total",
    with_views(["user_texts"], "SELECT CAST(count(*) AS BIGINT) AS total_texts FROM user_texts"),
)
def q_text_total(spark, d):
    return U.text_total(V.user_texts(spark, d))


_RATES_SQL = """
SELECT likes, dislikes, likes + dislikes AS total_feedback,
       CAST(round(CASE WHEN likes + dislikes > 0 THEN likes * 100.0 / (likes + dislikes) ELSE 0 END, 6) AS DOUBLE) AS like_pct,
       CAST(round(CASE WHEN likes + dislikes > 0 THEN dislikes * 100.0 / (likes + dislikes) ELSE 0 END, 6) AS DOUBLE) AS dislike_pct
FROM (SELECT CAST(count(*) FILTER (WHERE feedback_type = 'like') AS BIGINT) AS likes,
             CAST(count(*) FILTER (WHERE feedback_type = 'dislike') AS BIGINT) AS dislikes
      FROM user_feedback) t"""


@register("feedback_rates", with_views(["user_feedback"], _RATES_SQL))
def q_feedback_rates(spark, d):
    r = U.feedback_rates(V.user_feedback(spark, d))
    return r.select("likes", "dislikes", "total_feedback", _r("like_pct"), _r("dislike_pct"))


@register(
    "overview",
    with_views(
        ["login_history", "user_texts", "user_feedback"],
        """
SELECT (SELECT CAST(count(DISTINCT user_id) AS BIGINT) FROM login_history) AS unique_users,
       (SELECT CAST(count(*) AS BIGINT) FROM user_texts) AS total_texts,
       coalesce((SELECT model_used FROM user_texts WHERE NOT regexp_matches(model_used, '^[0-9]+$')
                 GROUP BY model_used ORDER BY count(*) DESC, model_used LIMIT 1), 'N/A') AS top_model,
       r.likes, r.dislikes, r.like_pct, r.dislike_pct
FROM ("""
        + _RATES_SQL
        + ") r",
    ),
)
def q_overview(spark, d):
    o = U.overview(V.login_history(spark, d), V.user_texts(spark, d), V.user_feedback(spark, d))
    return o.select(
        "unique_users", "total_texts", "top_model", "likes", "dislikes", _r("like_pct"), _r("dislike_pct")
    )


_FB_BASE = """
SELECT uf.id, uf.feedback_type, uf.comment, uf.created_at, u.username
FROM user_feedback uf JOIN users u ON uf.user_id = u.id"""


@register("feedback_recent", with_views(["user_feedback", "users"], _FB_BASE + " ORDER BY uf.created_at DESC, uf.id DESC"))
def q_feedback_recent(spark, d):
    return U.feedback_with_users(V.user_feedback(spark, d), V.users(spark, d), None)


@register(
    "feedback_liked",
    with_views(["user_feedback", "users"], _FB_BASE + " WHERE uf.feedback_type = 'like' ORDER BY uf.created_at DESC, uf.id DESC"),
)
def q_feedback_liked(spark, d):
    return U.feedback_with_users(V.user_feedback(spark, d), V.users(spark, d), "like")


@register(
    "feedback_disliked",
    with_views(
        ["user_feedback", "users"], _FB_BASE + " WHERE uf.feedback_type = 'dislike' ORDER BY uf.created_at DESC, uf.id DESC"
    ),
)
def q_feedback_disliked(spark, d):
    return U.feedback_with_users(V.user_feedback(spark, d), V.users(spark, d), "dislike")


@register(
    "texts_with_users",
    with_views(
        ["user_texts", "users"],
        """
SELECT ut.id, ut.input_text, ut.content_text, ut.content_type, ut.model_used, ut.created_at, u.username
FROM user_texts ut JOIN users u ON ut.user_id = u.id
ORDER BY ut.created_at DESC, ut.id DESC""",
    ),
)
def q_texts_with_users(spark, d):
    return U.texts_with_users(V.user_texts(spark, d), V.users(spark, d))


@register(
    "recent_logins",
    with_views(
        ["login_history", "users"],
        """
SELECT u.username, lh.login_time, lh.id AS login_id
FROM login_history lh JOIN users u ON lh.user_id = u.id
ORDER BY lh.login_time DESC NULLS LAST, lh.id DESC LIMIT 10""",
    ),
)
def q_recent_logins(spark, d):
    return U.recent_logins(V.login_history(spark, d), V.users(spark, d))


@register(
    "user_history",
    with_views(
        ["user_texts"],
        """
SELECT user_id, id, input_text, content_text, content_type, model_used, created_at,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, id DESC) AS BIGINT) AS record_no
FROM user_texts""",
    ),
)
def q_user_history(spark, d):
    """F1 + F5 for every user at once: history newest-first, numbered 1..n."""
    t = V.user_texts(spark, d).select("user_id", "id", *U.HISTORY_COLS)
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    return numbered_by_id(t, "id", ["id", "user_id", "created_at"], ["user_id"], order, "record_no")


@register(
    "user_history_labels",
    with_views(
        ["user_texts"],
        """
SELECT id, user_id,
       concat_ws(' - ', strftime(created_at, '%Y-%m-%d %H:%M:%S'), coalesce(content_type, 'None'),
                 coalesce(model_used, 'None')) AS label
FROM user_texts""",
    ),
)
def q_user_history_labels(spark, d):
    t = V.user_texts(spark, d)
    return t.select("id", "user_id", U.history_label().alias("label"))


@register("table_scan", with_views(["users"], "SELECT id, username, email, language_preference, role FROM users"))
def q_table_scan(spark, d):
    """A3/B1: full scan with explicit projection."""
    return V.users(spark, d).select("id", "username", "email", "language_preference", "role")


@register(
    "user_lookup",
    with_views(
        ["user_texts", "user_feedback"],
        """
SELECT user_id, id, input_text, content_text, content_type, model_used, created_at
FROM user_texts WHERE user_id IN (SELECT user_id FROM user_feedback WHERE feedback_type = 'dislike')""",
    ),
)
def q_user_lookup(spark, d):
    """B3 batch form: histories of every user who left a 'dislike'."""
    keys = U.feedback_filter(V.user_feedback(spark, d), "dislike")
    t = V.user_texts(spark, d).select("user_id", "id", *U.HISTORY_COLS)
    return U.semi_join_keys(t, "user_id", keys, "user_id")


@register(
    "key_exists",
    with_views(
        ["registrations", "users"],
        """
SELECT r.ord, (EXISTS (SELECT 1 FROM users u WHERE u.email = r.email)
               OR EXISTS (SELECT 1 FROM users u WHERE u.username = r.username)) AS taken
FROM registrations r""",
    ),
)
def q_key_exists(spark, d):
    """Does a user with this e-mail OR this user name exist (two semi
    probes, never an OR-join, which would plan as a nested loop)."""
    from ..operators.changes import key_taken

    return key_taken(V.registrations(spark, d), V.users(spark, d))
