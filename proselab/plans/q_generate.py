"""Registered generation-orchestration queries (K1-K8, K10) and oracles.

The generator is the deterministic extractive stand-in (see
``operators.generate``); the oracles re-implement it in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import generate as G
from ..sources import views as V
from ..sources.tables import read_table
from ..sources.views import with_views
from . import sqlgen as Q
from .registry import register

_MX, _MN = S.DEFAULT_SUMMARY_PARAMS[0], S.DEFAULT_SUMMARY_PARAMS[1]
_CH = S.CHUNK_TOKENS


def _docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


@register("chunks", Q.chunks_sql("documents", "doc_id", "text", _CH))
def q_chunks(spark, d):
    """K1: 512-token chunks of every document, in order."""
    c = G.chunk(_docs(spark, d), "doc_id", "text")
    return c.select("doc_id", F.col("chunk_no").cast("long"), "chunk_text", F.col("n_tokens").cast("long"))


@register(
    "chunk_merge",
    f"""WITH c AS ({Q.chunks_sql("documents", "doc_id", "text", _CH)})
SELECT doc_id, string_agg(chunk_text, ' ' ORDER BY chunk_no) AS merged FROM c GROUP BY doc_id""",
)
def q_chunk_merge(spark, d):
    """K3: chunks merged back in chunk order (equals the whitespace-normalised text)."""
    c = G.chunk(_docs(spark, d), "doc_id", "text")
    return G.merge_ordered(c, "doc_id", "chunk_no", "chunk_text", "merged")


_CHUNK_SUM_SQL = f"""WITH c AS ({Q.chunks_sql("documents", "doc_id", "text", _CH)}),
cs AS (SELECT concat(CAST(doc_id AS VARCHAR), ':', CAST(chunk_no AS VARCHAR)) AS ck, doc_id, chunk_no, chunk_text, {_MX} AS mx, {_MN} AS mn FROM c),
{Q.extractive_ctes("cs", "ck", "chunk_text", "mx", "mn", "e1")}"""


@register(
    "chunk_summaries",
    _CHUNK_SUM_SQL + "\nSELECT cs.doc_id, cs.chunk_no, o.generated AS summary FROM cs JOIN e1_out o ON o.ck = cs.ck",
)
def q_chunk_summaries(spark, d):
    """K2: the (extractive) generator on every chunk, long-summary lengths."""
    c = G.chunk(_docs(spark, d), "doc_id", "text")
    return G.extractive(c.withColumn("chunk_no", F.col("chunk_no").cast("long")), ["doc_id", "chunk_no"], "chunk_text", _MX, _MN, "summary")


def _marked(pdf):
    """Deterministic generator for ``chunk_errors``: the first 20 characters;
    it fails on any text with a bar, which no batch survives."""
    import pandas as pd

    out = []
    for t in pdf["piece"]:
        if "|" in t:
            raise ValueError("bar in text")
        out.append([t[:20]])
    return pd.DataFrame({"candidates": out})


@register(
    "chunk_errors",
    f"""WITH c AS ({Q.chunks_sql("documents", "doc_id", "text", _CH)}),
m AS (SELECT doc_id, CAST(count(*) FILTER (WHERE contains(chunk_text, '|')) AS BIGINT) AS failed_chunks,
             string_agg(left(chunk_text, 20), ' ' ORDER BY chunk_no) FILTER (WHERE NOT contains(chunk_text, '|')) AS merged
      FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.merged, '') AS paraphrase, coalesce(m.failed_chunks, 0) AS failed_chunks,
       CASE WHEN m.failed_chunks > 0 THEN 'ValueError: bar in text' END AS error
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id""",
)
def q_chunk_errors(spark, d):
    """K2 / K3 / K9: a generator that fails on some chunks; every failed
    chunk is counted and the other chunks of its batch are unharmed."""
    out = G.paraphrase_long(_docs(spark, d), "doc_id", "text", generator=_marked)
    return out.select("doc_id", "paraphrase", "failed_chunks", "error")


def _long_sql(src_docs: str, mx: int, mn: int, p: str) -> str:
    """CTEs ending in ``{p}_final(doc_id, summary)`` for documents in
    ``src_docs`` (doc_id, text)."""
    return f"""{p}_c AS ({Q.chunks_sql(src_docs, "doc_id", "text", _CH)}),
{p}_cs AS (SELECT concat(CAST(doc_id AS VARCHAR), ':', CAST(chunk_no AS VARCHAR)) AS ck, doc_id, chunk_no, chunk_text, {mx} AS mx, {mn} AS mn FROM {p}_c),
{Q.extractive_ctes(f"{p}_cs", "ck", "chunk_text", "mx", "mn", f"{p}_e1")},
{p}_m AS (SELECT cs.doc_id, string_agg(o.generated, ' ' ORDER BY cs.chunk_no) AS merged, {mx} AS mx, {mn} AS mn
          FROM {p}_cs cs JOIN {p}_e1_out o ON o.ck = cs.ck GROUP BY cs.doc_id),
{Q.extractive_ctes(f"{p}_m", "doc_id", "merged", "mx", "mn", f"{p}_e2")},
{p}_j AS (SELECT d.doc_id, coalesce(o.generated, '') AS g FROM {src_docs} d LEFT JOIN {p}_e2_out o ON o.doc_id = d.doc_id),
{Q.strip_prefixes_ctes(f"{p}_j", "doc_id", "g", S.UNWANTED_PREFIXES, f"{p}_x")},
{p}_final AS (SELECT doc_id, s AS summary FROM {p}_x_p{len(S.UNWANTED_PREFIXES)})"""


@register("long_summary", "WITH " + _long_sql("documents", _MX, _MN, "ls") + "\nSELECT doc_id, summary FROM ls_final")
def q_long_summary(spark, d):
    """K1 -> K2 -> K3 -> K4 -> I5 over every document (default lengths)."""
    return G.summarize(_docs(spark, d), "doc_id", "text").select("doc_id", "summary")


_MED = [p for p in S.SUMMARY_PRESETS if p[0] == "medium"][0]


def _direct_sql(src_docs: str, mx: int, mn: int, p: str) -> str:
    return f"""{p}_in AS (SELECT doc_id, text, {mx} AS mx, {mn} AS mn FROM {src_docs}),
{Q.extractive_ctes(f"{p}_in", "doc_id", "text", "mx", "mn", f"{p}_e")},
{Q.strip_prefixes_ctes(f"{p}_e_out", "doc_id", "generated", S.UNWANTED_PREFIXES, f"{p}_x")},
{p}_final AS (SELECT doc_id, s AS summary FROM {p}_x_p{len(S.UNWANTED_PREFIXES)})"""


_NW = Q.words("text")


@register(
    "summary_route",
    f"""WITH r AS (SELECT doc_id, text, CASE WHEN len({_NW}) < 500 THEN 'direct' ELSE 'long' END AS path FROM documents),
rd AS (SELECT doc_id, text FROM r WHERE path = 'direct'),
rl AS (SELECT doc_id, text FROM r WHERE path = 'long'),
{_direct_sql("rd", _MED[1], _MED[2], "dr")},
{_long_sql("rl", _MED[1], _MED[2], "lg")}
SELECT r.doc_id, r.path, s.summary FROM r JOIN (SELECT * FROM dr_final UNION ALL SELECT * FROM lg_final) s ON s.doc_id = r.doc_id""",
)
def q_summary_route(spark, d):
    """K5: route each document (medium preset) to the direct or the chunked path."""
    r = G.route_summaries(_docs(spark, d), "doc_id", "text", _MED[1], _MED[2], length_penalty=_MED[3], num_beams=_MED[4])
    return r.select("doc_id", "path", "summary")


def _sweep_sql() -> str:
    parts, ctes = [], []
    for name, mx, mn, _lp, _nb in S.SUMMARY_PRESETS:
        if name == "long":
            ctes.append(f"swd_{name} AS (SELECT doc_id, text FROM documents WHERE len({_NW}) <= {_CH})")
            ctes.append(f"swl_{name} AS (SELECT doc_id, text FROM documents WHERE len({_NW}) > {_CH})")
            ctes.append(_direct_sql(f"swd_{name}", mx, mn, f"sw_{name}"))
            ctes.append(_long_sql(f"swl_{name}", mx, mn, f"sw_{name}_l"))
            parts.append(f"SELECT doc_id, '{name}' AS preset, summary FROM sw_{name}_final")
            parts.append(f"SELECT doc_id, '{name}' AS preset, summary FROM sw_{name}_l_final")
        else:
            ctes.append(_direct_sql("documents", mx, mn, f"sw_{name}"))
            parts.append(f"SELECT doc_id, '{name}' AS preset, summary FROM sw_{name}_final")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


@register("preset_sweep", _sweep_sql())
def q_preset_sweep(spark, d):
    """Every document under the short / medium / long presets."""
    return G.preset_sweep(_docs(spark, d), "doc_id", "text").select("doc_id", "preset", "summary")


def _clean_first(g: str, src: str) -> str:
    sg = Q.strip(g)
    return f"CASE WHEN lower({sg}) <> lower({src}) THEN {sg} ELSE {src} END"


@register(
    "fill_levels",
    with_views(
        ["eval_pairs"],
        f""", fin AS (SELECT pid, coalesce(original, '') AS original, reference, {S.BATCH_FILL_MAX_NEW_TOKENS} AS mx, 0 AS mn FROM eval_pairs),
{Q.extractive_ctes("fin", "pid", "original", "mx", "mn", "fe")},
f1 AS (SELECT f.pid, f.original, f.reference, {_clean_first("o.generated", "f.original")} AS g FROM fin f JOIN fe_out o ON o.pid = f.pid)
SELECT pid, original, reference, g AS generated_conservative, g AS generated_balanced, g AS generated_creative FROM f1""",
    ),
)
def q_fill_levels(spark, d):
    """K6 + K7: each evaluation row x 3 levels, first cleaned candidate, in
    wide columns beside the original and the reference (stand-in generator)."""
    rows = V.eval_pairs(spark, d).select("pid", F.coalesce("original", F.lit("")).alias("original"), "reference")
    w = G.fill_levels(rows, "pid", "original")
    return w.select("pid", "original", "reference", *[f"generated_{lvl}" for lvl in S.LEVELS])


_PRESET_CASE = lambda field, idx: (
    "CASE level "
    + " ".join(f"WHEN '{p[0]}' THEN CAST({p[idx]} AS DOUBLE)" for p in S.LEVEL_PRESETS)
    + f" ELSE CAST({[p for p in S.LEVEL_PRESETS if p[0] == S.DEFAULT_LEVEL][0][idx]} AS DOUBLE) END AS {field}"
)


def _nth_candidates(k: int) -> str:
    """CTEs ``pk{k}_out``: the stand-in's k-th candidate of every request."""
    return f"""vk{k} AS (SELECT rid, text, max_new_tokens * {k} AS mx, 0 AS mn FROM v),
{Q.extractive_ctes(f"vk{k}", "rid", "text", "mx", "mn", f"pk{k}")}"""


@register(
    "paraphrase_response",
    with_views(
        ["requests"],
        f""", v AS (SELECT rid, text, level, model_name, coalesce(num_return_sequences, 1) AS n,
                   coalesce(max_new_tokens, {S.REQUEST_DEFAULT_MAX_NEW_TOKENS}) AS max_new_tokens FROM requests
           WHERE length(text) >= 3 AND {Q.strip('text')} <> ''),
{_nth_candidates(1)},
{_nth_candidates(2)},
{_nth_candidates(3)},
asked AS (SELECT rid, generated, 1 AS k FROM pk1_out UNION ALL SELECT rid, generated, 2 FROM pk2_out UNION ALL SELECT rid, generated, 3 FROM pk3_out),
cleaned AS (SELECT v.rid, {Q.strip('a.generated')} AS g, min(a.k) AS k FROM v JOIN asked a ON a.rid = v.rid AND a.k <= v.n
            WHERE lower({Q.strip('a.generated')}) <> lower(v.text) GROUP BY v.rid, g),
kept AS (SELECT rid, list(g ORDER BY k) AS gs FROM cleaned GROUP BY rid)
SELECT v.rid, coalesce(array_to_string(kept.gs, '\n'), v.text) AS paraphrases, CAST(coalesce(len(kept.gs), 1) AS INTEGER) AS n_paraphrases,
       v.n AS num_return_sequences, v.model_name, v.level, {_PRESET_CASE("temperature", 1)}, {_PRESET_CASE("top_p", 2)},
       {_PRESET_CASE("repetition_penalty", 3)}, v.max_new_tokens
FROM v LEFT JOIN kept ON kept.rid = v.rid""",
    ),
)
def q_paraphrase_response(spark, d):
    """K8: request rows -> response rows with as many candidates as asked for
    (stand-in generator)."""
    r = G.paraphrase_response(V.requests(spark, d), "rid")
    return r.select(
        "rid",
        F.array_join("paraphrases", "\n").alias("paraphrases"),
        F.size("paraphrases").alias("n_paraphrases"),
        F.col("generation_params.num_return_sequences").alias("num_return_sequences"),
        "model_name",
        "level",
        F.col("generation_params.temperature").alias("temperature"),
        F.col("generation_params.top_p").alias("top_p"),
        F.col("generation_params.repetition_penalty").alias("repetition_penalty"),
        F.col("generation_params.max_new_tokens").alias("max_new_tokens"),
    )


_PMX, _PMN = S.DEFAULT_PARAPHRASE_PARAMS[0], S.DEFAULT_PARAPHRASE_PARAMS[1]


def _para_long_sql(src_docs: str, mx: int, mn: int, p: str) -> str:
    """CTEs ending in ``{p}_final(doc_id, paraphrase)``: chunk, generate per
    chunk, merge in chunk order; no second pass."""
    return f"""{p}_c AS ({Q.chunks_sql(src_docs, "doc_id", "text", _CH)}),
{p}_cs AS (SELECT concat(CAST(doc_id AS VARCHAR), ':', CAST(chunk_no AS VARCHAR)) AS ck, doc_id, chunk_no, chunk_text, {mx} AS mx, {mn} AS mn FROM {p}_c),
{Q.extractive_ctes(f"{p}_cs", "ck", "chunk_text", "mx", "mn", f"{p}_e1")},
{p}_m AS (SELECT cs.doc_id, string_agg(o.generated, ' ' ORDER BY cs.chunk_no) AS merged
          FROM {p}_cs cs JOIN {p}_e1_out o ON o.ck = cs.ck GROUP BY cs.doc_id),
{p}_final AS (SELECT d.doc_id, coalesce(m.merged, '') AS paraphrase FROM {src_docs} d LEFT JOIN {p}_m m ON m.doc_id = d.doc_id)"""


@register("long_paraphrase", "WITH " + _para_long_sql("documents", _PMX, _PMN, "lp") + "\nSELECT doc_id, paraphrase FROM lp_final")
def q_long_paraphrase(spark, d):
    """K1 -> K2 -> K3 for paraphrases (default lengths 120/30)."""
    return G.paraphrase_long(_docs(spark, d), "doc_id", "text").select("doc_id", "paraphrase")


_INTER = [p for p in S.PARAPHRASE_PRESETS if p[0] == "Intermediate"][0]


@register(
    "paraphrase_route",
    f"""WITH r AS (SELECT doc_id, text, CASE WHEN len({_NW}) <= 100 THEN 'direct' ELSE 'long' END AS path FROM documents),
rd AS (SELECT doc_id, text, {_INTER[1]} AS mx, {_INTER[2]} AS mn FROM r WHERE path = 'direct'),
rl AS (SELECT doc_id, text FROM r WHERE path = 'long'),
{Q.extractive_ctes("rd", "doc_id", "text", "mx", "mn", "pd")},
{_para_long_sql("rl", _INTER[1], _INTER[2], "pl")}
SELECT r.doc_id, r.path, s.paraphrase FROM r
JOIN (SELECT doc_id, generated AS paraphrase FROM pd_out UNION ALL SELECT * FROM pl_final) s ON s.doc_id = r.doc_id""",
)
def q_paraphrase_route(spark, d):
    """K5 for paraphrases with the Intermediate reading-level preset."""
    r = G.route_paraphrases(_docs(spark, d), "doc_id", "text", _INTER[1], _INTER[2], length_penalty=_INTER[3], num_beams=_INTER[4])
    return r.select("doc_id", "path", "paraphrase")
