"""Registered change-application and audit queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as CH
from ..sources import views as V
from ..sources.views import with_views
from .registry import oracle_of, register


# Snapshots with every kind of violation planted: missing and overlong values,
# unknown feedback types, ids that occur twice, users that do not exist.
_DIRTY = """
, dirty_texts AS (
  SELECT id, CASE WHEN id % 10 = 1 THEN NULL WHEN id % 10 = 2 THEN -id ELSE user_id END AS user_id,
         CASE WHEN id % 10 = 3 THEN NULL ELSE input_text END AS input_text,
         CASE WHEN id % 10 = 4 THEN NULL ELSE content_text END AS content_text,
         CASE WHEN id % 10 = 5 THEN NULL WHEN id % 10 = 6 THEN concat(content_type, repeat('x', 20)) ELSE content_type END AS content_type,
         CASE WHEN id % 10 = 7 THEN repeat('m', 101) ELSE model_used END AS model_used FROM user_texts
  UNION ALL SELECT id, user_id, input_text, content_text, content_type, model_used FROM user_texts WHERE content_type = 'summary'),
dirty_feedback AS (
  SELECT id, CASE WHEN id % 7 = 1 THEN NULL WHEN id % 7 = 2 THEN -id ELSE user_id END AS user_id,
         CASE WHEN id % 7 = 3 THEN NULL WHEN id % 7 = 4 THEN 'meh' ELSE feedback_type END AS feedback_type FROM user_feedback
  UNION ALL SELECT id, user_id, feedback_type FROM user_feedback WHERE feedback_type = 'dislike'),
dirty_logins AS (SELECT id, CASE WHEN id % 9 = 1 THEN -id ELSE user_id END AS user_id FROM login_history UNION ALL SELECT id, user_id FROM login_history WHERE user_id IS NULL)"""


def _dirty(spark, d):
    """The same three snapshots as frames."""
    i = F.col("id")
    null = F.lit(None)
    t = V.user_texts(spark, d).select("id", "user_id", "input_text", "content_text", "content_type", "model_used")
    texts = t.select(
        "id",
        F.when(i % 10 == 1, null).when(i % 10 == 2, -i).otherwise(F.col("user_id")).alias("user_id"),
        F.when(i % 10 != 3, F.col("input_text")).alias("input_text"),
        F.when(i % 10 != 4, F.col("content_text")).alias("content_text"),
        F.when(i % 10 == 5, null).when(i % 10 == 6, F.concat("content_type", F.lit("x" * 20))).otherwise(F.col("content_type")).alias("content_type"),
        F.when(i % 10 == 7, "m" * 101).otherwise(F.col("model_used")).alias("model_used"),
    ).unionByName(t.filter(F.col("content_type") == "summary"))
    f = V.user_feedback(spark, d).select("id", "user_id", "feedback_type")
    feedback = f.select(
        "id",
        F.when(i % 7 == 1, null).when(i % 7 == 2, -i).otherwise(F.col("user_id")).alias("user_id"),
        F.when(i % 7 == 3, null).when(i % 7 == 4, "meh").otherwise(F.col("feedback_type")).alias("feedback_type"),
    ).unionByName(f.filter(F.col("feedback_type") == "dislike"))
    lg = V.login_history(spark, d).select("id", "user_id")
    logins = lg.select("id", F.when(i % 9 == 1, -i).otherwise(F.col("user_id")).alias("user_id")).unionByName(lg.filter(F.col("user_id").isNull()))
    return texts, feedback, logins


@register(
    "constraint_audit",
    with_views(
        ["users", "user_texts", "user_feedback", "login_history"],
        _DIRTY
        + """
, r AS (
  SELECT 'user_texts' AS table_name, rule, violations FROM (
    SELECT count(*) FILTER (WHERE user_id IS NULL) AS not_null_user_id,
           count(*) FILTER (WHERE input_text IS NULL) AS not_null_input_text,
           count(*) FILTER (WHERE content_text IS NULL) AS not_null_content_text,
           count(*) FILTER (WHERE content_type IS NULL) AS not_null_content_type,
           count(*) FILTER (WHERE length(content_type) > 20) AS len_content_type,
           count(*) FILTER (WHERE length(model_used) > 100) AS len_model_used
    FROM dirty_texts) UNPIVOT (violations FOR rule IN (not_null_user_id, not_null_input_text, not_null_content_text,
                                                    not_null_content_type, len_content_type, len_model_used))
  UNION ALL
  SELECT 'user_feedback', rule, violations FROM (
    SELECT count(*) FILTER (WHERE user_id IS NULL) AS not_null_user_id,
           count(*) FILTER (WHERE feedback_type IS NULL) AS not_null_feedback_type,
           count(*) FILTER (WHERE NOT (feedback_type IN ('like', 'dislike'))) AS enum_feedback_type
    FROM dirty_feedback) UNPIVOT (violations FOR rule IN (not_null_user_id, not_null_feedback_type, enum_feedback_type))
  UNION ALL
  SELECT 'user_texts', 'duplicate_pk', count(*) FROM (SELECT id FROM dirty_texts GROUP BY id HAVING count(*) > 1) d
  UNION ALL
  SELECT 'user_feedback', 'duplicate_pk', count(*) FROM (SELECT id FROM dirty_feedback GROUP BY id HAVING count(*) > 1) d
  UNION ALL
  SELECT 'login_history', 'duplicate_pk', count(*) FROM (SELECT id FROM dirty_logins GROUP BY id HAVING count(*) > 1) d
  UNION ALL
  SELECT 'user_texts', 'fk_user_id', count(*) FROM dirty_texts t WHERE t.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = t.user_id)
  UNION ALL
  SELECT 'user_feedback', 'fk_user_id', count(*) FROM dirty_feedback t WHERE t.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = t.user_id)
  UNION ALL
  SELECT 'login_history', 'fk_user_id', count(*) FROM dirty_logins t WHERE t.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = t.user_id))
SELECT table_name, rule, CAST(violations AS BIGINT) AS violations FROM r""",
    ),
)
def q_constraint_audit(spark, d):
    """B11 over snapshots with planted violations of every rule."""
    return CH.constraint_audit(V.users(spark, d), *_dirty(spark, d))


# The audit after a change set: missing contents are filled in, the likes come
# a second time, logins without a user go, and so do the admin accounts.
_AFTER = """
, after_users AS (SELECT id FROM users WHERE role <> 'admin'),
after_texts AS (SELECT id, user_id, input_text, coalesce(content_text, input_text, '') AS content_text, content_type, model_used FROM dirty_texts),
after_feedback AS (SELECT * FROM dirty_feedback UNION ALL SELECT * FROM dirty_feedback WHERE feedback_type = 'like'),
after_logins AS (SELECT * FROM dirty_logins WHERE user_id IS NOT NULL)"""


def _audit_after_sql() -> str:
    tables, rules = oracle_of("constraint_audit").split("\n, r AS (", 1)
    return tables + _AFTER + "\n, r AS (" + rules.replace("dirty_", "after_").replace("FROM users u", "FROM after_users u")


@register("constraint_audit_after", _audit_after_sql())
def q_constraint_audit_after(spark, d):
    """The audit after a change set, from the one before and the
    changed rows."""
    users = V.users(spark, d)
    texts, feedback, logins = _dirty(spark, d)
    came, went = F.lit(1).alias("change"), F.lit(-1).alias("change")
    gaps = texts.filter(F.col("content_text").isNull())
    filled = gaps.withColumn("content_text", F.coalesce("input_text", F.lit("")))
    changes = {
        "users": users.filter(F.col("role") == "admin").select("*", went),
        "user_texts": gaps.select("*", went).unionByName(filled.select("*", came)),
        "user_feedback": feedback.filter(F.col("feedback_type") == "like").select("*", came),
        "login_history": logins.filter(F.col("user_id").isNull()).select("*", went),
    }
    before = {"users": users, "user_texts": texts, "user_feedback": feedback, "login_history": logins}
    return CH.audit_after(CH.constraint_audit(users, texts, feedback, logins), before, changes)


@register(
    "fk_orphans",
    with_views(
        ["users", "profiles", "user_texts", "user_feedback", "login_history"],
        """
, left_users AS (SELECT id FROM users WHERE role <> 'admin')
SELECT 'profiles' AS table_name, user_id AS row_key, user_id FROM profiles p WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM left_users u WHERE u.id = p.user_id)
UNION ALL SELECT 'user_texts', id, user_id FROM user_texts t WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM left_users u WHERE u.id = t.user_id)
UNION ALL SELECT 'user_feedback', id, user_id FROM user_feedback t WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM left_users u WHERE u.id = t.user_id)
UNION ALL SELECT 'login_history', id, user_id FROM login_history t WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM left_users u WHERE u.id = t.user_id)""",
    ),
)
def q_fk_orphans(spark, d):
    """Rows of every child table whose user no longer exists, here after
    the admin accounts were deleted without their rows."""
    users = V.users(spark, d).filter(F.col("role") != "admin")
    parts = [
        CH.fk_orphans(V.profiles(spark, d), "user_id", users, "id").select(
            F.lit("profiles").alias("table_name"), F.col("user_id").alias("row_key"), "user_id"
        )
    ]
    for name, fn in (("user_texts", V.user_texts), ("user_feedback", V.user_feedback), ("login_history", V.login_history)):
        parts.append(
            CH.fk_orphans(fn(spark, d), "user_id", users, "id").select(
                F.lit(name).alias("table_name"), F.col("id").alias("row_key"), "user_id"
            )
        )
    return reduce(DataFrame.unionByName, parts)


# "first come wins" row by row: the taken e-mails and names travel along
_REGISTERED = f"""
, cand AS (
  SELECT r.ord, r.username, r.email, coalesce(r.language_preference, 'English') AS language_preference,
         row_number() OVER (ORDER BY r.ord) AS i
  FROM registrations r
  WHERE coalesce(regexp_matches(r.email, '{CH.EMAIL_PATTERN}'), false)
    AND NOT EXISTS (SELECT 1 FROM users u WHERE u.email = r.email)
    AND NOT EXISTS (SELECT 1 FROM users u WHERE u.username = r.username)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS es, CAST([] AS VARCHAR[]) AS us, false AS ok
  UNION ALL
  SELECT c.i, CASE WHEN list_contains(w.es, c.email) OR list_contains(w.us, c.username) THEN w.es ELSE list_append(w.es, c.email) END,
         CASE WHEN list_contains(w.es, c.email) OR list_contains(w.us, c.username) THEN w.us ELSE list_append(w.us, c.username) END,
         NOT (list_contains(w.es, c.email) OR list_contains(w.us, c.username))
  FROM walk w JOIN cand c ON c.i = w.i + 1),
accepted AS (SELECT c.* FROM cand c JOIN walk w ON w.i = c.i WHERE w.ok)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register(
    "register_batch",
    _recursive(with_views(["registrations", "users"], _REGISTERED + "\nSELECT ord, username, email, language_preference, 'user' AS role FROM accepted")),
)
def q_register_batch(spark, d):
    """H7 + C5: accepted registrations as new user rows; names and e-mails
    clash within the batch, in chains."""
    return CH.register_batch(V.registrations(spark, d), V.users(spark, d))


_NEW_ID = "(SELECT max(id) FROM users) + row_number() OVER (ORDER BY ord)"


@register(
    "register_users",
    _recursive(with_views(
        ["registrations", "users"],
        _REGISTERED + f"""
SELECT id, username, email, language_preference, role FROM users
UNION ALL SELECT {_NEW_ID}, username, email, language_preference, 'user' FROM accepted""",
    )),
)
def q_register_users(spark, d):
    """H7: the new ``users`` snapshot."""
    return CH.registered_tables(V.registrations(spark, d), V.users(spark, d), V.profiles(spark, d))[0]


@register(
    "register_profiles",
    _recursive(with_views(
        ["registrations", "users", "profiles"],
        _REGISTERED + f"""
SELECT user_id, age_group, language_preference FROM profiles
UNION ALL SELECT {_NEW_ID}, NULL, language_preference FROM accepted""",
    )),
)
def q_register_profiles(spark, d):
    """H7: the new ``profiles`` snapshot, keyed by the new users' ids."""
    return CH.registered_tables(V.registrations(spark, d), V.users(spark, d), V.profiles(spark, d))[1]


_ROLE_CH = """
, asked AS (SELECT user_id AS id, id AS seq,
                   CASE WHEN comment = 'flagged' THEN 'owner' WHEN feedback_type = 'like' THEN 'admin' ELSE 'user' END AS role
            FROM user_feedback),
ch AS (SELECT id, arg_max(role, seq) AS role FROM asked WHERE role IN ('admin', 'user') GROUP BY id)"""


def _role_changes(spark, d):
    """One change per feedback row: many per user, some with no such role."""
    role = F.when(F.col("comment") == "flagged", "owner").when(F.col("feedback_type") == "like", "admin").otherwise("user")
    return V.user_feedback(spark, d).select(F.col("user_id").alias("id"), F.col("id").alias("seq"), role.alias("role"))


@register(
    "role_update",
    with_views(
        ["users", "user_feedback"],
        _ROLE_CH
        + """
SELECT u.id, u.username, CASE WHEN ch.id IS NOT NULL THEN ch.role ELSE u.role END AS role
FROM users u LEFT JOIN ch ON ch.id = u.id""",
    ),
)
def q_role_update(spark, d):
    """H2: each feedback promotes (like) or demotes (dislike) its user; the
    last valid change per user holds."""
    out = CH.set_role(V.users(spark, d), _role_changes(spark, d))
    return out.select("id", "username", "role")


@register(
    "update_affected",
    with_views(
        ["users", "user_feedback"],
        _ROLE_CH + "\nSELECT CAST(count(*) AS BIGINT) AS affected FROM users u WHERE u.id IN (SELECT id FROM asked)",
    ),
)
def q_update_affected(spark, d):
    """H1: rows an update-by-key touches (the 'affected > 0' report)."""
    return CH.affected_count(V.users(spark, d), _role_changes(spark, d), "id")


@register(
    "text_update",
    with_views(
        ["user_texts", "user_feedback"],
        """
SELECT t.id, CASE WHEN f.id IS NOT NULL THEN '[removed]' ELSE t.content_text END AS content_text, f.id IS NOT NULL AS changed
FROM user_texts t LEFT JOIN (SELECT DISTINCT id FROM user_feedback WHERE comment = 'flagged') f ON f.id = t.id""",
    ),
)
def q_text_update(spark, d):
    """H3: replace the content of every flagged record by id."""
    flagged = V.user_feedback(spark, d).filter(F.col("comment") == "flagged").select("id").distinct()
    changes = flagged.withColumn("content_text", F.lit("[removed]"))
    t = V.user_texts(spark, d)
    return CH.update_by_key(t, changes, "id", ["content_text"], "changed").select("id", "content_text", "changed")


@register(
    "text_delete",
    with_views(
        ["user_texts", "user_feedback"],
        "SELECT id, user_id FROM user_texts WHERE id NOT IN (SELECT id FROM user_feedback WHERE feedback_type = 'dislike')",
    ),
)
def q_text_delete(spark, d):
    """H4: delete every disliked record by id."""
    keys = V.user_feedback(spark, d).filter(F.col("feedback_type") == "dislike")
    return CH.delete_by_key(V.user_texts(spark, d), keys, "id").select("id", "user_id")


@register(
    "user_cascade_delete",
    with_views(
        ["users", "profiles", "user_texts", "user_feedback", "login_history"],
        """
, gone AS (SELECT id FROM users WHERE role = 'admin')
SELECT 'login_history' AS table_name, CAST(count(*) AS BIGINT) AS rows_left FROM login_history WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'profiles', count(*) FROM profiles WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'user_feedback', count(*) FROM user_feedback WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'user_texts', count(*) FROM user_texts WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'users', count(*) FROM users WHERE id NOT IN (SELECT id FROM gone)""",
    ),
)
def q_user_cascade_delete(spark, d):
    """H5: delete all admin accounts everywhere; report rows left per table."""
    tables = {
        "users": V.users(spark, d),
        "profiles": V.profiles(spark, d),
        "user_texts": V.user_texts(spark, d),
        "user_feedback": V.user_feedback(spark, d),
        "login_history": V.login_history(spark, d),
    }
    gone = tables["users"].filter(F.col("role") == "admin").select("id")
    out = CH.delete_users_cascade(tables, gone)
    parts = [
        out[t].agg(F.count(F.lit(1)).cast("long").alias("rows_left")).select(F.lit(t).alias("table_name"), "rows_left")
        for t in ("login_history", "profiles", "user_feedback", "user_texts", "users")
    ]
    return reduce(DataFrame.unionByName, parts)


@register(
    "profile_upsert",
    with_views(
        ["profiles", "profile_changes"],
        """
, last AS (SELECT user_id, age_group, language_preference FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM profile_changes) z WHERE rn = 1)
SELECT coalesce(p.user_id, l.user_id) AS user_id,
       CASE WHEN l.user_id IS NOT NULL THEN l.age_group ELSE p.age_group END AS age_group,
       CASE WHEN l.user_id IS NOT NULL THEN l.language_preference ELSE p.language_preference END AS language_preference
FROM profiles p FULL OUTER JOIN last l ON l.user_id = p.user_id""",
    ),
)
def q_profile_upsert(spark, d):
    """H6: latest change per user updates or inserts the profile; a NULL
    age in the change is applied (not skipped)."""
    return CH.upsert_profiles(V.profiles(spark, d), V.profile_changes(spark, d), "seq")


def _rerun_batch(t):
    """The UI re-insert defect: every summary saved a second time, later."""
    return t.filter(F.col("content_type") == "summary").select(
        (F.col("id") + 1000000).alias("id"),
        "user_id", "input_text", "content_text", "content_type", "model_used",
        (F.col("created_at") + F.expr("INTERVAL 1 SECOND")).alias("created_at"),
    )


@register(
    "dedup_append",
    with_views(
        ["user_texts"],
        """
, batch AS (SELECT id + 1000000 AS id, user_id, input_text, content_text, content_type, model_used,
                   created_at + INTERVAL 1 SECOND AS created_at FROM user_texts WHERE content_type = 'summary'),
u AS (SELECT * FROM user_texts UNION ALL SELECT * FROM batch)
SELECT id, user_id, content_type, model_used, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, input_text, content_text, content_type, model_used
                               ORDER BY created_at, id) AS rn FROM u) z
WHERE rn = 1""",
    ),
)
def q_dedup_append(spark, d):
    """H8: idempotent append — re-saved rows collapse onto the earliest."""
    t = V.user_texts(spark, d)
    keys = ["user_id", "input_text", "content_text", "content_type", "model_used"]
    out = CH.dedup_append(t, _rerun_batch(t), keys, ["created_at", "id"])
    return out.select("id", "user_id", "content_type", "model_used", "created_at")
