"""Registered scalar-function queries (I1-I19, G1, B8-B10) and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..operators import changes as CH
from ..operators import generate as G
from ..sources import views as V
from ..sources.tables import read_table
from ..sources.views import with_views
from .registry import register

WS = X.WS_PORTABLE
# DuckDB spellings of the same helpers (used inside oracle SQL).
D_STRIP = "regexp_replace(@E@, '^" + WS + "+|" + WS + "+$', '', 'g')"
D_WORDS = "list_filter(regexp_split_to_array(coalesce(@E@, ''), '" + WS + "+'), lambda w: w <> '')"


def d_strip(e: str) -> str:
    return D_STRIP.replace("@E@", e)


def d_words(e: str) -> str:
    return D_WORDS.replace("@E@", e)


@register(
    "strip_lower",
    with_views(
        ["requests"],
        f"SELECT rid, {d_strip('text')} AS stripped, lower({d_strip('text')}) AS lowered FROM requests",
    ),
)
def q_strip_lower(spark, d):
    r = V.requests(spark, d)
    return r.select("rid", X.strip_ws("text").alias("stripped"), X.strip_lower("text").alias("lowered"))


@register(
    "word_route",
    f"""
SELECT doc_id, n_words,
       CASE WHEN n_words < 500 THEN 'direct' ELSE 'long' END AS summary_route,
       CASE WHEN n_words <= 100 THEN 'direct' ELSE 'long' END AS paraphrase_route
FROM (SELECT doc_id, CAST(len({d_words('text')}) AS BIGINT) AS n_words FROM documents) t""",
)
def q_word_route(spark, d):
    docs = read_table(spark, d, "documents")
    n = X.word_count("text").cast("long")
    return docs.select("doc_id", n.alias("n_words")).select(
        "doc_id", "n_words", X.summary_route(F.col("n_words")).alias("summary_route"),
        X.paraphrase_route(F.col("n_words")).alias("paraphrase_route"),
    )


@register(
    "preview",
    """
SELECT doc_id, CASE WHEN length(text) > 1000 THEN concat(substring(text, 1, 1000), '...') ELSE text END AS preview
FROM documents""",
)
def q_preview(spark, d):
    return read_table(spark, d, "documents").select("doc_id", X.preview("text").alias("preview"))


# Inputs for the prefix cleaner: conversation turns given summary-style
# prefixes chosen by turn number (one of six shapes, including none).
def _prefixed_spark(spark, d):
    c = read_table(spark, d, "conversations")
    k = F.pmod(F.col("turn"), F.lit(6))
    pre = (
        F.when(k == 0, "Summary: - ")
        .when(k == 1, "In conclusion, ")
        .when(k == 2, "Conclusions ")
        .when(k == 3, "CONCLUSION: summary -")
        .when(k == 4, "summary")
        .otherwise("")
    )
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("rid"), F.concat(pre, F.col("text")).alias("raw"))


_PREFIXED_SQL = """
SELECT conv_id * 1000 + turn AS rid,
       concat(CASE turn % 6 WHEN 0 THEN 'Summary: - ' WHEN 1 THEN 'In conclusion, ' WHEN 2 THEN 'Conclusions '
                            WHEN 3 THEN 'CONCLUSION: summary -' WHEN 4 THEN 'summary' ELSE '' END, text) AS raw
FROM conversations"""


def _d_prefix_step(src: str, prefix: str) -> str:
    n = len(prefix)
    rest = d_strip(f"substring(s, {n + 1}, 1073741824)")
    return f"""
SELECT rid, raw, CASE WHEN starts_with(lower(s), '{prefix}') THEN
         CASE WHEN starts_with(r, ':') OR starts_with(r, '-') THEN {d_strip('substring(r, 2, 1073741824)')} ELSE r END
       ELSE s END AS s
FROM (SELECT rid, raw, s, {rest} AS r FROM {src}) z"""


def _prefix_sql() -> str:
    sql = f"WITH p0 AS (SELECT rid, raw, raw AS s FROM ({_PREFIXED_SQL}) q)"
    for i, p in enumerate(S.UNWANTED_PREFIXES):
        sql += f",\np{i + 1} AS ({_d_prefix_step(f'p{i}', p)})"
    return sql + f"\nSELECT rid, raw, s AS cleaned FROM p{len(S.UNWANTED_PREFIXES)}"


@register("prefix_clean", _prefix_sql())
def q_prefix_clean(spark, d):
    p = _prefixed_spark(spark, d)
    return p.select("rid", "raw", X.strip_unwanted_prefixes("raw").alias("cleaned"))


_TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in S.BANNED_TERMS) + "]"


@register(
    "banned_terms",
    f"""
SELECT doc_id, CAST(len(h) AS BIGINT) AS n_banned, array_to_string(h, '|') AS banned
FROM (SELECT doc_id, list_filter({_TERMS_SQL}, lambda t: instr(lower(coalesce(text, '')), t) > 0) AS h FROM documents) z""",
)
def q_banned_terms(spark, d):
    docs = read_table(spark, d, "documents")
    h = X.banned_hits("text")
    return docs.select("doc_id", F.size(h).cast("long").alias("n_banned"), F.array_join(h, "|").alias("banned"))


@register(
    "prompts",
    with_views(
        ["dataset"],
        """
SELECT ord, CASE WHEN task = 'summary' THEN concat('Summarize: ', input_text)
                 ELSE concat('Paraphrase this academically: ', input_text) END AS reference_prompt,
       CASE WHEN instr(CASE WHEN ord % 2 = 0 THEN 'google/pegasus-xsum' ELSE 'Pegasus-XSum' END, 'Pegasus') > 0
            THEN concat('Summarize the following text clearly and concisely without adding any external information: ', input_text)
            ELSE input_text END AS summary_prompt
FROM dataset""",
    ),
)
def q_prompts(spark, d):
    ds = V.dataset(spark, d)
    model = F.when(F.pmod(F.col("ord"), F.lit(2)) == 0, "google/pegasus-xsum").otherwise("Pegasus-XSum")
    return ds.select(
        "ord",
        X.reference_prompt("task", "input_text").alias("reference_prompt"),
        X.summary_prompt("input_text", model).alias("summary_prompt"),
    )


@register(
    "model_alias",
    with_views(
        ["requests"],
        """
SELECT rid, model_name, CASE WHEN lower(model_name) = 't5' THEN 'ramsrigouthamg/t5_paraphraser'
                             WHEN lower(model_name) = 'bart' THEN 'eugenesiow/bart-paraphrase'
                             ELSE model_name END AS model_repo
FROM requests""",
    ),
)
def q_model_alias(spark, d):
    return V.requests(spark, d).select("rid", "model_name", X.model_repo("model_name").alias("model_repo"))


@register(
    "age_default",
    with_views(
        ["profiles"],
        f"""
SELECT user_id, age, age BETWEEN 18 AND 65 AS in_range
FROM (SELECT user_id, CASE WHEN regexp_matches(age_group, '{X.INT_TEXT_PORTABLE}') THEN coalesce(TRY_CAST({d_strip('age_group')} AS INTEGER), 18)
                           ELSE 18 END AS age FROM profiles) z""",
    ),
)
def q_age_default(spark, d):
    p = V.profiles(spark, d).select("user_id", X.lenient_int("age_group").alias("age"))
    return p.select("user_id", "age", F.col("age").between(S.AGE_MIN, S.AGE_MAX).alias("in_range"))


_LANG_CASE = " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in S.LANG_CODES)


@register(
    "lang_code",
    with_views(
        ["users"],
        f"""
SELECT id, language_preference, CASE language_preference {_LANG_CASE} END AS lang_code,
       CAST(CASE WHEN language_preference = 'English' THEN 0 ELSE 1 END AS INTEGER) AS pref_index
FROM users""",
    ),
)
def q_lang_code(spark, d):
    u = V.users(spark, d)
    return u.select(
        "id",
        "language_preference",
        X.lang_code("language_preference").alias("lang_code"),
        F.when(F.col("language_preference") == "English", 0).otherwise(1).cast("int").alias("pref_index"),
    )


@register(
    "label_caps",
    with_views(
        ["user_feedback"],
        "SELECT id, concat(upper(substring(feedback_type, 1, 1)), lower(substring(feedback_type, 2, 1073741824))) AS label FROM user_feedback",
    ),
)
def q_label_caps(spark, d):
    return V.user_feedback(spark, d).select("id", X.capitalize("feedback_type").alias("label"))


@register(
    "rounded",
    """
SELECT source, CAST(round(avg(n_chars), 1) AS DOUBLE) AS avg_chars_1,
       CAST(round(avg(n_chars), 2) AS DOUBLE) AS avg_chars_2,
       CAST(round(avg(n_chars), 3) AS DOUBLE) AS avg_chars_3
FROM documents GROUP BY source""",
)
def q_rounded(spark, d):
    docs = read_table(spark, d, "documents")
    a = docs.groupBy("source").agg(F.avg("n_chars").alias("m"))
    return a.select(
        "source",
        F.round("m", 1).alias("avg_chars_1"),
        F.round("m", 2).alias("avg_chars_2"),
        F.round("m", 3).alias("avg_chars_3"),
    )


@register(
    "defaults",
    with_views(
        ["user_texts"],
        "SELECT id, coalesce(model_used, '') AS model_or_blank, coalesce(content_type, '') AS type_or_blank FROM user_texts",
    ),
)
def q_defaults(spark, d):
    """NULL -> '' / default."""
    t = V.user_texts(spark, d)
    return t.select(
        "id",
        F.coalesce("model_used", F.lit("")).alias("model_or_blank"),
        F.coalesce("content_type", F.lit("")).alias("type_or_blank"),
    )


_PRESETS_SQL = "(VALUES " + ", ".join(f"('{n}', CAST({t} AS DOUBLE), CAST({p} AS DOUBLE), CAST({r} AS DOUBLE))" for n, t, p, r in S.LEVEL_PRESETS) + ") AS lp(level, temperature, top_p, repetition_penalty)"


@register(
    "gen_params",
    with_views(
        ["requests"],
        f"""
SELECT r.rid, r.level, coalesce(lp.temperature, b.temperature) AS temperature,
       coalesce(lp.top_p, b.top_p) AS top_p, coalesce(lp.repetition_penalty, b.repetition_penalty) AS repetition_penalty,
       true AS do_sample, coalesce(r.num_return_sequences, 1) AS num_return_sequences, coalesce(r.max_new_tokens, 50) AS max_new_tokens,
       CAST(1 AS INTEGER) AS num_beams, true AS clean_up_tokenization_spaces
FROM requests r LEFT JOIN {_PRESETS_SQL} ON lp.level = r.level
JOIN (SELECT * FROM {_PRESETS_SQL.replace(' lp(', ' b(')}) b ON b.level = 'balanced'""",
    ),
)
def q_gen_params(spark, d):
    r = V.requests(spark, d)
    p = G.generation_params(r)
    return p.select("rid", "level", "gp.*")


def _cands_spark(spark, d):
    r = V.requests(spark, d)
    nxt = r.select((F.col("rid") - 1).alias("_rid"), F.col("text").alias("_next"))
    j = r.join(nxt, r["rid"] == nxt["_rid"], "left")
    nx = F.coalesce(F.col("_next"), F.lit("x"))
    cands = F.array(F.col("text"), F.lower("text"), F.concat(F.lit(" "), F.col("text"), F.lit(" ")), nx, nx)
    return j.select("rid", "text", cands.alias("cands"))


_CANDS_SQL = """
SELECT r.rid, r.text, [r.text, lower(r.text), concat(' ', r.text, ' '), coalesce(n.text, 'x'), coalesce(n.text, 'x')] AS cands
FROM requests r LEFT JOIN requests n ON n.rid = r.rid + 1"""


@register(
    "candidate_clean",
    with_views(
        ["requests"],
        f"""
, c AS ({_CANDS_SQL}),
e AS (SELECT rid, text, i, {d_strip('cands[i]')} AS cand
      FROM (SELECT rid, text, cands, unnest(range(1, len(cands) + 1)) AS i FROM c) u),
f AS (SELECT * FROM e WHERE lower(cand) <> lower(text)),
firsts AS (SELECT rid, cand, min(i) AS i FROM f GROUP BY rid, cand),
ranked AS (SELECT rid, cand, CAST(row_number() OVER (PARTITION BY rid ORDER BY i) AS INTEGER) AS pos FROM firsts)
SELECT rid, pos, cand FROM ranked
UNION ALL
SELECT rid, CAST(1 AS INTEGER) AS pos, text AS cand FROM c WHERE rid NOT IN (SELECT rid FROM f)""",
    ),
)
def q_candidate_clean(spark, d):
    c = _cands_spark(spark, d)
    cleaned = X.clean_candidates("cands", "text")
    return c.select("rid", F.posexplode_outer(cleaned).alias("pos", "cand")).filter(F.col("pos").isNotNull()).select(
        "rid", (F.col("pos") + 1).cast("int").alias("pos"), "cand"
    )


@register(
    "valid_requests",
    with_views(
        ["requests"],
        f"SELECT rid, (length(text) >= 3 AND {d_strip('text')} <> '') AS valid FROM requests",
    ),
)
def q_valid_requests(spark, d):
    r = V.requests(spark, d)
    return r.select("rid", G.request_ok("text").alias("valid"))


@register(
    "email_check",
    with_views(
        ["registrations"],
        f"SELECT ord, email, coalesce(regexp_matches(email, '{CH.EMAIL_PATTERN}'), false) AS email_ok FROM registrations",
    ),
)
def q_email_check(spark, d):
    r = V.registrations(spark, d)
    return r.select("ord", "email", CH.email_ok("email").alias("email_ok"))


@register(
    "required_fields",
    with_views(
        ["registrations"],
        """
SELECT ord, (coalesce(username, '') <> '' AND coalesce(email, '') <> '' AND coalesce(language_preference, '') <> '') AS complete
FROM registrations""",
    ),
)
def q_required_fields(spark, d):
    r = V.registrations(spark, d)
    return r.select("ord", CH.required_ok("username", "email", "language_preference").alias("complete"))
