"""Registered text-metric queries (J1-J7, J14) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import metrics as M
from ..sources import views as V
from ..sources.views import with_views
from . import sqlgen as Q
from .registry import register

_LEVEL_CASE = "CASE lv.level WHEN 'conservative' THEN e.generated_conservative WHEN 'balanced' THEN e.generated_balanced ELSE e.generated_creative END"

# Long-form evaluation pairs (C7 + B7 + I10) with tokens, as SQL CTEs.
PAIRS_SQL = f""", lp AS (
  SELECT e.pid, lv.level, lv.level_order, coalesce(e.original, '') AS original,
         {Q.strip("coalesce(e.reference, '')")} AS reference, {_LEVEL_CASE} AS g
  FROM eval_pairs e, {Q.LEVELS_VALUES}),
pairs AS (SELECT pid, level, pid * 10 + level_order AS lk, original, reference, {Q.fallback('g', 'original')} AS generated
          FROM lp WHERE reference <> ''),
tok AS (SELECT pid, level, lk, {Q.rouge_tokens('generated')} AS h, {Q.rouge_tokens('reference')} AS r FROM pairs)"""


def _r6(c: str) -> str:
    return f"CAST(round({c}, 6) AS DOUBLE)"


def _s6(c):
    return F.round(F.col(c), 6).alias(c)


def _pairs(spark, d):
    return EV.level_pairs(V.eval_pairs(spark, d))


@register(
    "rouge_n",
    with_views(
        ["eval_pairs"],
        PAIRS_SQL
        + ",\n"
        + Q.ngram_ctes("tok", ["pid", "level"], [1, 2], "rn")
        + f"""
SELECT pid, level, {_r6(Q.f_measure('ov1', 'hc1', 'rc1'))} AS rouge1_f, {_r6(Q.f_measure('ov2', 'hc2', 'rc2'))} AS rouge2_f
FROM rn_ov""",
    ),
)
def q_rouge_n(spark, d):
    r = M.rouge_n(_pairs(spark, d), ["pid", "level"], "generated", "reference", stem=False)
    return r.select("pid", "level", _s6("rouge1_f"), _s6("rouge2_f"))


_LCS_F = (
    "CASE WHEN len(t.h) > 0 AND len(t.r) > 0 AND l.lcs > 0 THEN "
    "2.0 * (l.lcs / len(t.h)) * (l.lcs / len(t.r)) / ((l.lcs / len(t.h)) + (l.lcs / len(t.r))) ELSE 0.0 END"
)


@register(
    "rouge_l",
    with_views(
        ["eval_pairs"],
        PAIRS_SQL
        + ",\n"
        + Q.lcs_ctes("tok", "lk", "rl")
        + f"""
SELECT t.pid, t.level, {_r6(_LCS_F)} AS rougeL_f
FROM tok t JOIN rl_rec l ON l.lk = t.lk""",
    ),
)
def q_rouge_l(spark, d):
    r = M.rouge_l(_pairs(spark, d), ["pid", "level"], "generated", "reference", stem=False)
    return r.select("pid", "level", _s6("rougeL_f"))


_BLEU_TOK = f""", btok AS (SELECT pid, level, {Q.words('generated')} AS h, {Q.words('reference')} AS r FROM pairs)"""


def _bleu_expr() -> str:
    logs = " + ".join(
        f"0.25 * ln(CASE WHEN ov{n} = 0 THEN 0.1 / greatest(hc{n}, 1) ELSE ov{n} / greatest(hc{n}, 1) END)" for n in (1, 2, 3, 4)
    )
    bp = "CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 ELSE exp(1.0 - ref_len / hyp_len) END"
    return f"CASE WHEN ov1 = 0 THEN 0.0 ELSE ({bp}) * exp({logs}) END"


@register(
    "bleu4",
    with_views(
        ["eval_pairs"],
        PAIRS_SQL
        + _BLEU_TOK
        + ",\n"
        + Q.ngram_ctes("btok", ["pid", "level"], [1, 2, 3, 4], "bl")
        + f"""
SELECT pid, level, {_r6(_bleu_expr())} AS bleu FROM bl_ov""",
    ),
)
def q_bleu4(spark, d):
    b = M.bleu4(_pairs(spark, d), ["pid", "level"], "generated", "reference")
    return b.select("pid", "level", _s6("bleu"))


@register(
    "self_rouge",
    with_views(
        ["user_texts"],
        f""", st AS (SELECT id, {Q.rouge_tokens('content_text')} AS h, {Q.rouge_tokens('input_text')} AS r
              FROM user_texts WHERE content_type = 'paraphrase'),
"""
        + Q.ngram_ctes("st", ["id"], [1, 2], "sr")
        + f"""
SELECT id, {_r6(Q.f_measure('ov1', 'hc1', 'rc1'))} AS rouge1_f, {_r6(Q.f_measure('ov2', 'hc2', 'rc2'))} AS rouge2_f
FROM sr_ov""",
    ),
)
def q_self_rouge(spark, d):
    """J14 n-gram part: how much of each paraphrase copies its input."""
    t = V.user_texts(spark, d).filter(F.col("content_type") == "paraphrase")
    r = M.rouge_n(t, ["id"], "content_text", "input_text", stem=False)
    return r.select("id", _s6("rouge1_f"), _s6("rouge2_f"))


@register("self_rouge_l")
def q_self_rouge_l(spark, d):
    """J14 LCS part over whole documents (stemmed, as the reference scores
    it).  No SQL oracle: LCS over whole documents is too slow as SQL; the
    pytest suite checks it against a plain dynamic-programming LCS."""
    t = V.user_texts(spark, d)
    r = EV.self_rouge(t, "id", stem=True)
    return r.select("id", _s6("rouge1_f"), _s6("rouge2_f"), _s6("rougeL_f"))


COSINE_CTE = """cosines AS (
SELECT pid, CAST(round(CASE WHEN nu > 0 AND nv > 0 THEN dot / (nu * nv) ELSE 0.0 END, 6) AS DOUBLE) AS cosine
FROM (SELECT pid, list_dot_product(CAST(u AS DOUBLE[]), CAST(v AS DOUBLE[])) AS dot,
             sqrt(list_dot_product(CAST(u AS DOUBLE[]), CAST(u AS DOUBLE[]))) AS nu,
             sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS nv FROM vector_pairs) z)"""

# best match of every token occurrence; a pair with one side only scores 0
SOFT_CTES = """un AS (SELECT pid, side, pos, CAST(vec AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) AS n
         FROM token_vectors),
sim AS (SELECT a.pid, a.side, a.pos, max(CASE WHEN a.n > 0 AND b.n > 0 THEN list_dot_product(a.v, b.v) / (a.n * b.n) ELSE 0.0 END) AS best
        FROM un a LEFT JOIN un b ON a.pid = b.pid AND a.side <> b.side GROUP BY a.pid, a.side, a.pos),
pr AS (SELECT pid, coalesce(avg(best) FILTER (WHERE side = 'hyp'), 0.0) AS p, coalesce(avg(best) FILTER (WHERE side = 'ref'), 0.0) AS r
       FROM sim GROUP BY pid),
softs AS (SELECT pid, CAST(round(p, 6) AS DOUBLE) AS soft_p, CAST(round(r, 6) AS DOUBLE) AS soft_r,
                 CAST(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS DOUBLE) AS soft_f
          FROM pr)"""


@register("cosine_pairs", with_views(["vector_pairs"], f", {COSINE_CTE}\nSELECT pid, cosine FROM cosines"))
def q_cosine_pairs(spark, d):
    vp = V.vector_pairs(spark, d)
    return vp.select("pid", F.round(M.cosine("u", "v"), 6).alias("cosine"))


@register("soft_match", with_views(["token_vectors"], f", {SOFT_CTES}\nSELECT pid, soft_p, soft_r, soft_f FROM softs"))
def q_soft_match(spark, d):
    s = M.soft_match(V.token_vectors(spark, d))
    return s.select("pid", _s6("soft_p"), _s6("soft_r"), _s6("soft_f"))
