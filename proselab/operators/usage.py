"""Usage analytics over the application tables.

Every operator is ``DataFrame(s) -> DataFrame`` and stays declarative so
Catalyst prunes columns, pushes filters to the scan and picks join strategies
(AQE converts a join to broadcast only when the runtime size is under the
broadcast threshold, so no unchecked ``broadcast()`` hints here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collated
from ..schemas import RECENT_LOGINS, TOP_MODEL_FALLBACK

ALL_DIGITS = "^[0-9]+$"


# ---------------------------------------------------------------- filters --
def is_model_name(name):
    """Not all digits (NULL for a NULL name, as SQL's NOT REGEXP)."""
    return ~name.rlike(ALL_DIGITS)


def exclude_numeric_models(texts: DataFrame) -> DataFrame:
    """Keep rows whose model name is not all digits (NULL names drop;
    '' is kept)."""
    return texts.filter(is_model_name(F.col("model_used")))


def feedback_filter(feedback: DataFrame, kind: str | None) -> DataFrame:
    """``None`` / 'recent' -> all rows, 'like' / 'dislike' -> that type."""
    if kind in (None, "recent", "all"):
        return feedback
    return feedback.filter(F.col("feedback_type") == F.lit(kind))


def lookup_by_key(df: DataFrame, key: str, value, collation: str | None = None) -> DataFrame:
    """B3 single-key form (pushed down to the parquet scan as an equality,
    unless it is compared under a ``collation``)."""
    return df.filter(collated(key, collation) == F.lit(value))


def semi_join_keys(df: DataFrame, key: str, keys: DataFrame, keys_col: str, collation: str | None = None) -> DataFrame:
    """B3 batch form: rows whose ``key`` appears in a key set, compared under
    ``collation`` if one is given."""
    k = keys.select(collated(keys_col, collation).alias("_k")).filter(F.col("_k").isNotNull())
    return df.join(k, collated(df[key], collation) == k["_k"], "left_semi")


# ------------------------------------------------------------------ joins --
def texts_with_users(texts: DataFrame, users: DataFrame) -> DataFrame:
    """Every generated text with its author's name, newest first."""
    u = users.select(F.col("id").alias("_uid"), "username")
    return (
        texts.join(u, texts["user_id"] == u["_uid"], "inner")
        .select("id", "input_text", "content_text", "content_type", "model_used", "created_at", "username")
        .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    )


def feedback_with_users(feedback: DataFrame, users: DataFrame, kind: str | None = None) -> DataFrame:
    """C2 (+B5): feedback rows with user name, optional like/dislike filter."""
    u = users.select(F.col("id").alias("_uid"), "username")
    return (
        feedback_filter(feedback, kind)
        .join(u, feedback["user_id"] == u["_uid"], "inner")
        .select("id", "feedback_type", "comment", "created_at", "username")
        .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    )


def recent_logins(logins: DataFrame, users: DataFrame, n: int = RECENT_LOGINS) -> DataFrame:
    """The ``n`` latest logins with user name.

    ``orderBy().limit(n)`` plans as TakeOrderedAndProject: each task keeps a
    heap of ``n`` rows, so only ``n * tasks`` rows ever reach one place.
    """
    u = users.select(F.col("id").alias("_uid"), "username")
    return (
        logins.join(u, logins["user_id"] == u["_uid"], "inner")
        .select("username", "login_time", F.col("id").alias("login_id"))
        .orderBy(F.col("login_time").desc_nulls_last(), F.col("login_id").desc())
        .limit(n)
    )


# ----------------------------------------------------------- aggregations --
def unique_logins(logins: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct non-NULL users that logged in.  ``approx=True`` uses a
    HyperLogLog++ sketch (one fixed-size buffer per task, no shuffle of
    user ids) when an exact count is not required."""
    if approx:
        return logins.agg(F.approx_count_distinct("user_id", rsd).alias("unique_users"))
    return logins.agg(F.count_distinct("user_id").alias("unique_users"))


def text_total(texts: DataFrame) -> DataFrame:
    """Number of generated texts."""
    return texts.agg(F.count(F.lit(1)).alias("total_texts"))


def model_counts(texts: DataFrame, collation: str | None = None) -> DataFrame:
    """D3: usage count per model (numeric names excluded).  Names that are
    equal under ``collation`` are one model, shown by its least spelling."""
    named, n = exclude_numeric_models(texts), F.count(F.lit(1)).alias("usage_count")
    if not collation:
        return named.groupBy("model_used").agg(n)
    return named.groupBy(collated("model_used", collation).alias("_k")).agg(F.min("model_used").alias("model_used"), n).drop("_k")


def model_usage(texts: DataFrame, collation: str | None = None) -> DataFrame:
    """Usage count per model, descending."""
    return model_counts(texts, collation).orderBy(F.col("usage_count").desc(), F.col("model_used"))


def top_model(texts: DataFrame) -> DataFrame:
    """Most used model, ties to the smallest name, 'N/A' when none.

    One global aggregate over the (small) per-model counts: ``min_by`` over
    the key (-count, name) picks the winner without sorting.
    """
    usage = model_counts(texts)
    return usage.agg(
        F.coalesce(
            F.min_by("model_used", F.struct(-F.col("usage_count"), F.col("model_used"))),
            F.lit(TOP_MODEL_FALLBACK),
        ).alias("top_model")
    )


def _rate(part: str, total: str):
    return F.when(F.col(total) > 0, F.col(part) * 100.0 / F.col(total)).otherwise(F.lit(0.0))


def feedback_rates(feedback: DataFrame) -> DataFrame:
    """like/dislike counts and percentages in one scan (0 when empty)."""
    agg = feedback.agg(
        F.count_if(F.col("feedback_type") == "like").cast("long").alias("likes"),
        F.count_if(F.col("feedback_type") == "dislike").cast("long").alias("dislikes"),
    ).withColumn("total_feedback", F.col("likes") + F.col("dislikes"))
    return agg.select(
        "likes",
        "dislikes",
        "total_feedback",
        _rate("likes", "total_feedback").alias("like_pct"),
        _rate("dislikes", "total_feedback").alias("dislike_pct"),
    )


def overview(logins: DataFrame, texts: DataFrame, feedback: DataFrame) -> DataFrame:
    """D1 + D2 + D4 + D5 as one row, from ONE global aggregation.

    The three inputs are projected to a tagged narrow union (no joins, no
    cross product); every branch is partially aggregated before the single
    final aggregate.  Model counts are pre-aggregated per model first.
    """
    # one aggregation serves both: rows per model name, counted or not
    per_model = texts.groupBy("model_used").agg(F.count(F.lit(1)).alias("n"))
    counted = is_model_name(F.col("model_used"))
    usage = per_model.select(
        F.lit(None).cast("long").alias("login_user"),
        F.col("n").alias("n_texts"),
        F.when(counted, F.col("model_used")).alias("model_used"),
        F.when(counted, F.col("n")).alias("usage_count"),
        F.lit(None).cast("string").alias("feedback_type"),
    )
    lg = logins.select(F.col("user_id").alias("login_user")).distinct().select(
        "login_user",
        F.lit(0).cast("long").alias("n_texts"),
        F.lit(None).cast("string").alias("model_used"),
        F.lit(None).cast("long").alias("usage_count"),
        F.lit(None).cast("string").alias("feedback_type"),
    )
    fb = feedback.select(
        F.lit(None).cast("long").alias("login_user"),
        F.lit(0).cast("long").alias("n_texts"),
        F.lit(None).cast("string").alias("model_used"),
        F.lit(None).cast("long").alias("usage_count"),
        F.col("feedback_type"),
    )
    u = lg.unionByName(usage).unionByName(fb)
    row = u.agg(
        F.count("login_user").alias("unique_users"),
        F.sum("n_texts").cast("long").alias("total_texts"),
        F.coalesce(
            F.min_by(
                "model_used",
                F.when(F.col("usage_count").isNotNull(), F.struct(-F.col("usage_count"), F.col("model_used"))),
            ),
            F.lit(TOP_MODEL_FALLBACK),
        ).alias("top_model"),
        F.count_if(F.col("feedback_type") == "like").cast("long").alias("likes"),
        F.count_if(F.col("feedback_type") == "dislike").cast("long").alias("dislikes"),
    ).withColumn("total_feedback", F.col("likes") + F.col("dislikes"))
    return row.select(
        "unique_users",
        "total_texts",
        "top_model",
        "likes",
        "dislikes",
        _rate("likes", "total_feedback").alias("like_pct"),
        _rate("dislikes", "total_feedback").alias("dislike_pct"),
    )


# ---------------------------------------------------------- sort / paging --
HISTORY_COLS = ["input_text", "content_text", "content_type", "model_used", "created_at"]


def user_history(texts: DataFrame, user_id) -> DataFrame:
    """one user's history, newest first (the filter reaches the scan)."""
    return (
        lookup_by_key(texts, "user_id", user_id)
        .select("id", *HISTORY_COLS)
        .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    )


def history_label(created_at: str = "created_at", ctype: str = "content_type", model: str = "model_used"):
    """I16: ``created_at - type - model`` label (NULL model prints 'None')."""
    return F.concat_ws(
        " - ",
        F.date_format(F.col(created_at), "yyyy-MM-dd HH:mm:ss"),
        F.coalesce(F.col(ctype), F.lit("None")),
        F.coalesce(F.col(model), F.lit("None")),
    )
