"""Application tables derived from the driver tables.

The reference keeps five relational tables, a dataset CSV and evaluation CSVs.
Here each one is a view over the driver's parquet tables, written twice:
once with the DataFrame API (what our queries use) and once as SQL text
(inlined as a CTE by the DuckDB oracles).  The CASE rules plant the special
rows the operators must handle (NULL / all-digit model names, NULL logins,
unparsable ages, blank references, repeated inputs).  Every view keeps every
row of its source that qualifies by meaning (e.g. a login is a signup/view
event); texts are always whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _mod(c: str | Column, m: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.pmod(c, F.lit(m))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(_mod(k, 3) == 0, "Hindi").otherwise("English").alias("language_preference"),
        F.when(_mod(k, 50) == 0, "admin").otherwise("user").alias("role"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("user_id"),
        F.when(_mod(k, 5) == 0, "None")
        .when(_mod(k, 11) == 0, F.concat(k.cast("string"), F.lit("99999999999")))
        .when(_mod(k, 7) == 0, F.lit(None).cast("string"))
        .otherwise((F.lit(15) + _mod(k, 60)).cast("string"))
        .alias("age_group"),
        F.when(_mod(k, 3) == 0, "Hindi").otherwise("English").alias("language_preference"),
    )


def login_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.filter(F.col("event_type").isin("signup", "view")).select(
        F.col("event_id").alias("id"),
        F.when(_mod("event_id", 97) == 0, F.lit(None).cast("long"))
        .otherwise(F.col("user_id"))
        .alias("user_id"),
        F.col("ts").alias("login_time"),
    )


def user_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").alias("d")
    e = read_table(spark, sf_dir, "events").alias("e")
    n = read_table(spark, sf_dir, "documents").alias("n")
    did = F.col("d.doc_id")
    return (
        d.join(e, F.col("e.event_id") == did, "inner")
        # the sum stands on the side of ``n``, so that the texts joined so far stay where they are
        .join(n, F.try_subtract(F.col("n.doc_id"), F.lit(1)) == did, "left")
        .select(
            did.alias("id"),
            F.col("e.user_id").alias("user_id"),
            F.col("d.text").alias("input_text"),
            F.coalesce(F.col("n.text"), F.col("d.text")).alias("content_text"),
            F.when(_mod(did, 2) == 0, "summary").otherwise("paraphrase").alias("content_type"),
            F.when(_mod(did, 11) == 0, F.lit(None).cast("string"))
            .when(_mod(did, 7) == 0, did.cast("string"))
            .otherwise(F.concat(F.lit("model-"), F.col("d.lang")))
            .alias("model_used"),
            F.col("e.ts").alias("created_at"),
        )
    )


def user_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels").alias("l")
    e = read_table(spark, sf_dir, "events").alias("e")
    return lab.join(e, F.col("e.event_id") == F.col("l.doc_id"), "inner").select(
        F.col("l.doc_id").alias("id"),
        F.col("e.user_id").alias("user_id"),
        F.when(F.col("l.quality") == 1, "like").otherwise("dislike").alias("feedback_type"),
        F.when(F.col("l.toxic") == 1, "flagged").alias("comment"),
        F.col("e.ts").alias("created_at"),
    )


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "documents").alias("a")
    b = read_table(spark, sf_dir, "documents").alias("b")
    cond = (F.col("b.doc_id") == F.col("a.doc_id") + 1) & (F.col("b.lang") == F.col("a.lang"))
    return a.join(b, cond, "left").select(
        F.col("a.doc_id").alias("ord"),
        F.col("a.text").alias("input_text"),
        F.col("b.text").alias("target_text"),
        F.when(_mod("a.doc_id", 2) == 0, "summary").otherwise("paraphrase").alias("task"),
        F.col("a.source").alias("domain"),
    )


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation CSV rows: original, reference and one text per level."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a = conv.alias("a")

    def nb(alias: str, delta: int) -> DataFrame:
        return conv.select(
            F.col("conv_id").alias(f"{alias}_conv"),
            (F.col("turn") - delta).alias(f"{alias}_turn"),
            F.col("text").alias(f"{alias}_text"),
        )

    out = a.filter(F.col("role") == "user")
    for alias, delta in (("n1", 1), ("n2", 2), ("p1", -1)):
        o = nb(alias, delta)
        out = out.join(
            o,
            (F.col(f"{alias}_conv") == F.col("a.conv_id")) & (F.col(f"{alias}_turn") == F.col("a.turn")),
            "left",
        )
    return out.select(
        (F.col("a.conv_id") * 1000 + F.col("a.turn")).alias("pid"),
        F.col("a.text").alias("original"),
        F.when(_mod("a.conv_id", 10) == 0, F.lit("  ")).otherwise(F.col("n1_text")).alias("reference"),
        F.col("a.text").alias("generated_conservative"),
        F.when(_mod("a.turn", 4) == 0, F.col("n2_text")).otherwise(F.lit("")).alias("generated_balanced"),
        F.col("p1_text").alias("generated_creative"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    return conv.select(
        (cid * 1000 + turn).alias("rid"),
        F.when(turn == 3, F.lit("    ")).when(turn == 4, F.lit("ab")).otherwise(F.col("text")).alias("text"),
        F.when(_mod(cid, 4) == 0, "conservative")
        .when(_mod(cid, 4) == 1, "balanced")
        .when(_mod(cid, 4) == 2, "creative")
        .otherwise("other")
        .alias("level"),
        F.when(_mod(cid, 3) == 0, "t5").when(_mod(cid, 3) == 1, "BART").otherwise("custom/model").alias("model_name"),
        F.when(_mod(cid, 3) > 0, _mod(cid, 3) + 1).cast("int").alias("num_return_sequences"),
        F.when(_mod(cid, 5) > 0, _mod(cid, 5) * 4).cast("int").alias("max_new_tokens"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        (k + 1000000).alias("ord"),
        F.when(_mod(k, 5) == 0, F.col("c_name"))
        # three neighbours want one name, two want one e-mail: chains of clashes
        .otherwise(F.concat(F.lit("new"), F.floor(k / F.lit(3)).cast("string")))
        .alias("username"),
        F.when(_mod(k, 7) == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")))
        .when(_mod(k, 13) == 0, F.concat(F.lit("bad"), k.cast("string")))
        .otherwise(F.concat(F.lit("n"), F.floor(k / F.lit(2)).cast("string"), F.lit("@example.org")))
        .alias("email"),
        F.lit("admin").alias("role"),
        F.when(_mod(k, 9) == 0, F.lit(None).cast("string")).otherwise(F.lit("Hindi")).alias("language_preference"),
    )


def profile_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.filter(F.col("event_type") == "click").select(
        eid.alias("seq"),
        # some changes are for users without a profile yet
        F.when(_mod(eid, 10) == 3, F.col("user_id") + 1000000).otherwise(F.col("user_id")).alias("user_id"),
        F.when(_mod(eid, 6) == 0, F.lit(None).cast("string"))
        .otherwise((F.lit(20) + _mod(eid, 40)).cast("string"))
        .alias("age_group"),
        F.when(_mod(eid, 2) == 0, "Hindi").otherwise("English").alias("language_preference"),
    )


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "embeddings").alias("a")
    b = read_table(spark, sf_dir, "embeddings").alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1, "inner").select(
        F.col("a.vec_id").alias("pid"), F.col("a.embedding").alias("u"), F.col("b.embedding").alias("v")
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    return e.select(
        F.floor(vid / F.lit(20.0)).cast("long").alias("pid"),
        # every 9th pair has one side only
        F.when((_mod(vid, 20) < 10) | (_mod(F.floor(vid / F.lit(20)), 9) == 4), "ref").otherwise("hyp").alias("side"),
        vid.alias("tok"),
        _mod(vid, 20).alias("pos"),
        F.col("embedding").alias("vec"),
    )


VIEW_BUILDERS = {
    "users": users,
    "profiles": profiles,
    "login_history": login_history,
    "user_texts": user_texts,
    "user_feedback": user_feedback,
    "dataset": dataset,
    "eval_pairs": eval_pairs,
    "requests": requests,
    "registrations": registrations,
    "profile_changes": profile_changes,
    "vector_pairs": vector_pairs,
    "token_vectors": token_vectors,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEW_BUILDERS[name](spark, sf_dir)


# --------------------------------------------------------------------------
# The same views as SQL text, for the DuckDB oracles (inlined as CTEs).
# --------------------------------------------------------------------------
VIEW_SQL = {
    "users": """
SELECT c_custkey AS id, c_name AS username,
       concat('u', CAST(c_custkey AS VARCHAR), '@example.com') AS email,
       CASE WHEN c_custkey % 3 = 0 THEN 'Hindi' ELSE 'English' END AS language_preference,
       CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role
FROM customer""",
    "profiles": """
SELECT c_custkey AS user_id,
       CASE WHEN c_custkey % 5 = 0 THEN 'None' WHEN c_custkey % 11 = 0 THEN concat(CAST(c_custkey AS VARCHAR), '99999999999')
            WHEN c_custkey % 7 = 0 THEN NULL
            ELSE CAST(15 + c_custkey % 60 AS VARCHAR) END AS age_group,
       CASE WHEN c_custkey % 3 = 0 THEN 'Hindi' ELSE 'English' END AS language_preference
FROM customer""",
    "login_history": """
SELECT event_id AS id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS user_id,
       ts AS login_time
FROM events WHERE event_type IN ('signup', 'view')""",
    "user_texts": """
SELECT d.doc_id AS id, e.user_id AS user_id, d.text AS input_text,
       coalesce(n.text, d.text) AS content_text,
       CASE WHEN d.doc_id % 2 = 0 THEN 'summary' ELSE 'paraphrase' END AS content_type,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 7 = 0 THEN CAST(d.doc_id AS VARCHAR)
            ELSE concat('model-', d.lang) END AS model_used,
       e.ts AS created_at
FROM documents d JOIN events e ON e.event_id = d.doc_id
LEFT JOIN documents n ON n.doc_id = d.doc_id + 1""",
    "user_feedback": """
SELECT l.doc_id AS id, e.user_id AS user_id,
       CASE WHEN l.quality = 1 THEN 'like' ELSE 'dislike' END AS feedback_type,
       CASE WHEN l.toxic = 1 THEN 'flagged' END AS comment,
       e.ts AS created_at
FROM labels l JOIN events e ON e.event_id = l.doc_id""",
    "dataset": """
SELECT a.doc_id AS ord, a.text AS input_text, b.text AS target_text,
       CASE WHEN a.doc_id % 2 = 0 THEN 'summary' ELSE 'paraphrase' END AS task,
       a.source AS domain
FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.lang = a.lang""",
    "eval_pairs": """
SELECT a.conv_id * 1000 + a.turn AS pid, a.text AS original,
       CASE WHEN a.conv_id % 10 = 0 THEN '  ' ELSE n1.text END AS reference,
       a.text AS generated_conservative,
       CASE WHEN a.turn % 4 = 0 THEN n2.text ELSE '' END AS generated_balanced,
       p1.text AS generated_creative
FROM conversations a
LEFT JOIN conversations n1 ON n1.conv_id = a.conv_id AND n1.turn = a.turn + 1
LEFT JOIN conversations n2 ON n2.conv_id = a.conv_id AND n2.turn = a.turn + 2
LEFT JOIN conversations p1 ON p1.conv_id = a.conv_id AND p1.turn = a.turn - 1
WHERE a.role = 'user'""",
    "requests": """
SELECT conv_id * 1000 + turn AS rid,
       CASE WHEN turn = 3 THEN '    ' WHEN turn = 4 THEN 'ab' ELSE text END AS text,
       CASE conv_id % 4 WHEN 0 THEN 'conservative' WHEN 1 THEN 'balanced' WHEN 2 THEN 'creative' ELSE 'other' END AS level,
       CASE conv_id % 3 WHEN 0 THEN 't5' WHEN 1 THEN 'BART' ELSE 'custom/model' END AS model_name,
       CASE WHEN conv_id % 3 > 0 THEN CAST(conv_id % 3 + 1 AS INTEGER) END AS num_return_sequences,
       CASE WHEN conv_id % 5 > 0 THEN CAST(conv_id % 5 * 4 AS INTEGER) END AS max_new_tokens
FROM conversations""",
    "registrations": """
SELECT c_custkey + 1000000 AS ord,
       CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE concat('new', CAST(c_custkey // 3 AS VARCHAR)) END AS username,
       CASE WHEN c_custkey % 7 = 0 THEN concat('u', CAST(c_custkey AS VARCHAR), '@example.com')
            WHEN c_custkey % 13 = 0 THEN concat('bad', CAST(c_custkey AS VARCHAR))
            ELSE concat('n', CAST(c_custkey // 2 AS VARCHAR), '@example.org') END AS email,
       'admin' AS role,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'Hindi' END AS language_preference
FROM customer""",
    "profile_changes": """
SELECT event_id AS seq, CASE WHEN event_id % 10 = 3 THEN user_id + 1000000 ELSE user_id END AS user_id,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(20 + event_id % 40 AS VARCHAR) END AS age_group,
       CASE WHEN event_id % 2 = 0 THEN 'Hindi' ELSE 'English' END AS language_preference
FROM events WHERE event_type = 'click'""",
    "vector_pairs": """
SELECT a.vec_id AS pid, a.embedding AS u, b.embedding AS v
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "token_vectors": """
SELECT CAST(floor(vec_id / 20.0) AS BIGINT) AS pid,
       CASE WHEN vec_id % 20 < 10 OR (vec_id // 20) % 9 = 4 THEN 'ref' ELSE 'hyp' END AS side,
       vec_id AS tok, vec_id % 20 AS pos, embedding AS vec
FROM embeddings""",
}


def with_views(names: list[str] | tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the CTEs of the named views (order kept)."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in names)
    return f"WITH {ctes}\n{body.strip()}"
