"""Registered queries whose keys are compared without regard to case: an
optional collation on B3, B4, C5, D3 and H7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as CH
from ..operators import usage as U
from ..sources import views as V
from ..sources.views import with_views
from .registry import register

LCASE = "UTF8_LCASE"

# registrations in mixed case: the same clashes, but for the letters' case
_MIXED = """
, mixed AS (
  SELECT ord, CASE WHEN ord % 3 = 0 THEN upper(username) ELSE username END AS username,
         CASE WHEN ord % 2 = 0 THEN upper(email) ELSE email END AS email, role, language_preference FROM registrations)"""


def _mixed(spark, d):
    return (
        V.registrations(spark, d)
        .withColumn("username", F.when(F.col("ord") % 3 == 0, F.upper("username")).otherwise(F.col("username")))
        .withColumn("email", F.when(F.col("ord") % 2 == 0, F.upper("email")).otherwise(F.col("email")))
    )


@register(
    "user_lookup_lcase",
    with_views(
        ["registrations", "users"],
        _MIXED + """
SELECT u.id, u.username, u.email FROM users u WHERE lower(u.email) IN (SELECT lower(email) FROM mixed)""",
    ),
)
def q_user_lookup_lcase(spark, d):
    """The accounts behind a set of e-mails typed in any case."""
    return U.semi_join_keys(V.users(spark, d), "email", _mixed(spark, d), "email", LCASE).select("id", "username", "email")


@register(
    "key_exists_lcase",
    with_views(
        ["registrations", "users"],
        _MIXED + """
SELECT r.ord, (EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(r.email))
               OR EXISTS (SELECT 1 FROM users u WHERE lower(u.username) = lower(r.username))) AS taken
FROM mixed r""",
    ),
)
def q_key_exists_lcase(spark, d):
    """Taken in whatever case."""
    return CH.key_taken(_mixed(spark, d), V.users(spark, d), LCASE)


@register(
    "reject_existing_lcase",
    with_views(
        ["registrations", "users"],
        _MIXED + """
SELECT r.ord, r.username, r.email FROM mixed r
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(r.email))
  AND NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.username) = lower(r.username))""",
    ),
)
def q_reject_existing_lcase(spark, d):
    """Registrations that clash with no account in any case."""
    return CH.reject_existing(_mixed(spark, d), V.users(spark, d), LCASE).select("ord", "username", "email")


@register(
    "model_usage_lcase",
    with_views(
        ["user_texts"],
        """
, t AS (SELECT CASE WHEN id % 4 = 0 THEN upper(model_used) ELSE model_used END AS model_used FROM user_texts)
SELECT min(model_used) AS model_used, CAST(count(*) AS BIGINT) AS usage_count
FROM t WHERE NOT regexp_matches(model_used, '^[0-9]+$') GROUP BY lower(model_used)""",
    ),
)
def q_model_usage_lcase(spark, d):
    """D3: spellings of a model name that differ in case are one model."""
    name = F.col("model_used")
    texts = V.user_texts(spark, d).select(F.when(F.col("id") % 4 == 0, F.upper(name)).otherwise(name).alias("model_used"))
    return U.model_usage(texts, LCASE)


_WALK = f"""
, cand AS (
  SELECT r.ord, r.username, r.email, lower(r.email) AS le, lower(r.username) AS lu,
         coalesce(r.language_preference, 'English') AS language_preference, row_number() OVER (ORDER BY r.ord) AS i
  FROM mixed r
  WHERE coalesce(regexp_matches(r.email, '{CH.EMAIL_PATTERN}'), false)
    AND NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(r.email))
    AND NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.username) = lower(r.username))),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS es, CAST([] AS VARCHAR[]) AS us, false AS ok
  UNION ALL
  SELECT c.i, CASE WHEN list_contains(w.es, c.le) OR list_contains(w.us, c.lu) THEN w.es ELSE list_append(w.es, c.le) END,
         CASE WHEN list_contains(w.es, c.le) OR list_contains(w.us, c.lu) THEN w.us ELSE list_append(w.us, c.lu) END,
         NOT (list_contains(w.es, c.le) OR list_contains(w.us, c.lu))
  FROM walk w JOIN cand c ON c.i = w.i + 1)
SELECT c.ord, c.username, c.email, c.language_preference, 'user' AS role FROM cand c JOIN walk w ON w.i = c.i WHERE w.ok"""


@register("register_batch_lcase", with_views(["registrations", "users"], _MIXED + _WALK).replace("WITH ", "WITH RECURSIVE ", 1))
def q_register_batch_lcase(spark, d):
    """H7: registrations in order of arrival, keys clashing in any case."""
    return CH.register_batch(_mixed(spark, d), V.users(spark, d), LCASE)
