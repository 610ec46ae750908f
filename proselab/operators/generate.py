"""Batch generation orchestration.

The reference calls neural models per chunk; the weights are not part of it,
so what is rebuilt here is the *orchestration*: routing by length, ordered
chunking, per-chunk generation, ordered merge, the second summary pass,
prefix clean-up, level presets and candidate clean-up.

Generation itself is pluggable:

* ``generator=None`` uses a deterministic **extractive stand-in**
  (sentence scoring by in-text word frequency), run per text like a model
  call.  It is labelled as such and is not comparable to neural output.
* a user ``Generator`` (``pandas.DataFrame -> pandas.DataFrame``) runs
  through ``mapInPandas``: Arrow batches, the model loaded once per Python
  worker, one output row per input row, failures captured per row (K9).

Failures are data: every summary, route and sweep output carries the number
of failed pieces and the first error, so a merged text that lacks a chunk says
so.

Chunks are bounded (``CHUNK_TOKENS`` words), so each generator call works
on a bounded input.  Chunk rows stay in the task that read their document
(one document is one row, so its size is bounded by the row size), and only
the short chunk outputs are shuffled, once, to merge each document in chunk
order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import arrow as A
from ..functions import text as X

Generator = Callable[[pd.DataFrame], pd.DataFrame]

SENTENCE = r"[^.!?]+[.!?]*"
SCORE_TOKEN = r"[a-z0-9]+"


# ------------------------------------------------------------- requests --
def request_ok(c: str | Column) -> Column:
    """At least 3 characters and not blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((F.length(c) >= S.REQUEST_MIN_CHARS) & (X.strip_ws(c) != ""), F.lit(False))


def split_valid(requests: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) frames; rejected rows carry the reason."""
    ok = request_ok(text_col)
    valid = requests.filter(ok)
    rejected = requests.filter(~ok).withColumn(
        "reason",
        F.when(F.coalesce(F.length(text_col), F.lit(0)) < S.REQUEST_MIN_CHARS, "too short").otherwise("empty text"),
    )
    return valid, rejected


def level_preset(level: str | Column) -> Column:
    """Level -> struct(temperature, top_p, repetition_penalty); unknown
    levels get the 'balanced' preset.  A 3-entry literal map: no join."""
    level = F.col(level) if isinstance(level, str) else level
    m = F.create_map(
        *[
            x
            for name, t, p, r in S.LEVEL_PRESETS
            for x in (
                F.lit(name),
                F.struct(
                    F.lit(t).cast("double").alias("temperature"),
                    F.lit(p).cast("double").alias("top_p"),
                    F.lit(r).cast("double").alias("repetition_penalty"),
                ),
            )
        ]
    )
    return F.coalesce(F.element_at(m, level), F.element_at(m, F.lit(S.DEFAULT_LEVEL)))


def generation_params(
    requests: DataFrame,
    level_col: str = "level",
    n_col: str | None = "num_return_sequences",
    max_tokens_col: str | None = "max_new_tokens",
    default_n: int = S.REQUEST_DEFAULT_N,
    default_max_tokens: int = S.REQUEST_DEFAULT_MAX_NEW_TOKENS,
) -> DataFrame:
    """Add ``gp`` = preset + fixed flags + request n / max tokens; a
    NULL or missing request value takes its default (I18)."""
    p = level_preset(level_col)

    def asked(col: str | None, default: int) -> Column:
        given = F.col(col).cast("int") if col and col in requests.columns else F.lit(None)
        return F.coalesce(given, F.lit(default)).cast("int")

    n, mx = asked(n_col, default_n), asked(max_tokens_col, default_max_tokens)
    gp = F.struct(
        p["temperature"].alias("temperature"),
        p["top_p"].alias("top_p"),
        p["repetition_penalty"].alias("repetition_penalty"),
        F.lit(S.GEN_DO_SAMPLE).alias("do_sample"),
        n.alias("num_return_sequences"),
        mx.alias("max_new_tokens"),
        F.lit(S.GEN_NUM_BEAMS).alias("num_beams"),
        F.lit(S.GEN_CLEAN_UP_TOKENIZATION_SPACES).alias("clean_up_tokenization_spaces"),
    )
    return requests.withColumn("gp", gp)


# --------------------------------------------------------------- chunking --
def chunk_texts(words: Column, max_tokens: int) -> Column:
    """Consecutive runs of at most ``max_tokens`` words, each joined with one
    space; an empty array for no word.  Evaluated per chunk, not per word."""
    n = F.ceil(F.size(words) / F.lit(max_tokens)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * max_tokens + 1, max_tokens), " "))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def chunk(df: DataFrame, key: str, text_col: str, max_tokens: int = S.CHUNK_TOKENS) -> DataFrame:
    """K1: consecutive, non-overlapping chunks of at most ``max_tokens``
    whitespace tokens (last may be short; empty text -> no chunk), tokens
    re-joined with one space.  One pass over the text per row, no shuffle.
    Output: key, chunk_no (0-based), chunk_text, n_tokens."""
    w = df.select(key, X.words(text_col).alias("_w"))
    # *_outer + explicit filter: an inner generator makes Spark infer and push
    # down a size filter, which would split the text twice.
    x = w.select(key, F.posexplode_outer(chunk_texts(F.col("_w"), max_tokens)).alias("chunk_no", "chunk_text"))
    return x.filter(F.col("chunk_text").isNotNull()).select(
        key, "chunk_no", "chunk_text", F.size(F.split("chunk_text", " ")).alias("n_tokens")
    )


def merge_ordered(parts: DataFrame, key: str, pos: str, text_col: str, out: str = "merged") -> DataFrame:
    """K3: join the pieces of each key in ``pos`` order with one space.
    The merged string is one output value per key, no larger than the
    document it came from."""
    g = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text_col).alias("t")))).alias("_xs"))
    return g.select(key, F.array_join(F.transform("_xs", lambda x: x["t"]), " ").alias(out))


# ------------------------------------------------ extractive stand-in (K2) --
_SENT_RE = re.compile(SENTENCE)
_TOKEN_RE = re.compile(SCORE_TOKEN)


def _ranked_sentences(text: str | None) -> list[tuple[int, str, int]]:
    """(position, sentence, word count) in rank order: score = mean in-text
    frequency of the sentence's lower-case ``[a-z0-9]+`` words (0 without
    words), ranked by (score desc, position asc)."""
    sents = [s.strip() for s in _SENT_RE.findall(text or "")]
    sents = [(i, s) for i, s in enumerate(sents) if s]
    toks = [_TOKEN_RE.findall(s.lower()) for _, s in sents]
    freq = Counter(t for ts in toks for t in ts)
    scored = [
        (-(sum(freq[t] for t in ts) / len(ts)) if ts else 0.0, i, s)
        for (i, s), ts in zip(sents, toks)
    ]
    scored.sort(key=lambda x: (x[0], x[1]))
    return [(i, s, len(s.split())) for _neg, i, s in scored]


def _select(ranked: list[tuple[int, str, int]], max_len: int, min_len: int) -> str:
    keep, total = [], 0
    for rank, (i, s, n) in enumerate(ranked, 1):
        before, total = total, total + n
        if rank == 1 or total <= max_len or before < min_len:
            keep.append((i, s))
    keep.sort()
    return " ".join(s for _, s in keep)


def extract_summary(text: str | None, max_len: int, min_len: int) -> str:
    """The stand-in generator for one text (plain Python, a few lines).

    Sentences are the ``[^.!?]+[.!?]*`` pieces, stripped, non-empty, ranked
    by the mean in-text frequency of their words.  The top sentence is
    always kept, then every sentence whose running word count
    (``str.split``) by rank stays within ``max_len`` or whose preceding
    total is below ``min_len``.  Kept sentences are joined in text order
    with one space; no sentence gives ''."""
    return _select(_ranked_sentences(text), max_len, min_len)


def extract_summaries(text: str | None, lengths: list[tuple[int, int]]) -> list[str]:
    """The stand-in for several (max_len, min_len) settings of one text:
    the sentences are scored once, only the selection differs."""
    ranked = _ranked_sentences(text)
    return [_select(ranked, mx, mn) for mx, mn in lengths]


@F.arrow_udf(T.StringType())
def _extractive_udf(text: pa.Array, max_len: pa.Array, min_len: pa.Array) -> pa.Array:
    lengths = zip(max_len.to_pylist(), min_len.to_pylist())
    return A.one_by_one(pa.string(), (extract_summary(t, mx, mn) for t, (mx, mn) in zip(A.texts_of(text), lengths)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _extractive_candidates_udf(text: pa.Array, max_len: pa.Array, min_len: pa.Array, n: pa.Array) -> pa.Array:
    asked = zip(max_len.to_pylist(), min_len.to_pylist(), n.to_pylist())
    return A.one_by_one(
        pa.list_(pa.string()),
        (extract_summaries(t, [(mx * i, mn) for i in range(1, k + 1)]) for t, (mx, mn, k) in zip(A.texts_of(text), asked)),
    )


_PRESET_LENGTHS = [(m, n) for _p, m, n, _a, _b in S.SUMMARY_PRESETS]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _extractive_multi_udf(text: pa.Array) -> pa.Array:
    return A.one_by_one(pa.list_(pa.string()), (extract_summaries(t, _PRESET_LENGTHS) for t in A.texts_of(text)))


def extractive(
    df: DataFrame, key: str | list[str], text_col: str, max_len: str | int, min_len: str | int, out: str = "generated"
) -> DataFrame:
    """Run the deterministic extractive stand-in generator on each row.

    Like a model call it is per text: an Arrow UDF that holds one text of the
    batch at a time, rows stay in their partitions (no shuffle, no explode).  ``key`` names the
    column(s) passed through; ``max_len``/``min_len`` are column names or
    ints.  One output row per input row."""
    keys = [key] if isinstance(key, str) else list(key)
    mx = F.col(max_len) if isinstance(max_len, str) else F.lit(max_len)
    mn = F.col(min_len) if isinstance(min_len, str) else F.lit(min_len)
    return df.select(*keys, _extractive_udf(F.col(text_col), mx.cast("int"), mn.cast("int")).alias(out))


def run_generator(
    df: DataFrame, key: str, text_col: str, generator: Generator, params_cols: list[str], out: str = "generated",
    passthrough: tuple[str, ...] | list[str] = (),
) -> DataFrame:
    """Run a user generator with ``mapInPandas``.

    The generator gets a pandas frame (key, text, params..., passthrough...)
    and returns a frame with ``candidates`` (list[str]) and ``error``
    (str or None), one row per input row in the same order; the input
    columns are carried over, so no join back is needed.  When a batch
    raises, its rows are generated one by one, so only the rows that fail
    carry an error (K9) and the job goes on.  Rows with a NULL text are not
    sent to the generator; their candidate is ''.  ``out`` is the first
    candidate."""
    cols = list(dict.fromkeys([key, text_col, *params_cols, *passthrough]))
    src = df.select(*cols)
    schema = T.StructType(
        list(src.schema.fields)
        + [
            T.StructField("candidates", T.ArrayType(T.StringType()), True),
            T.StructField("error", T.StringType(), True),
        ]
    )

    def _once(pdf: pd.DataFrame) -> tuple[list, list]:
        g = generator(pdf)
        if len(g) != len(pdf):
            raise ValueError(f"generator returned {len(g)} rows for {len(pdf)}")
        return list(g["candidates"]), list(g["error"]) if "error" in g else [None] * len(pdf)

    def _rows(pdf: pd.DataFrame) -> tuple[list, list]:
        try:
            return _once(pdf)
        except Exception as e:  # noqa: BLE001 - per-row failure capture
            if len(pdf) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
        parts = [_rows(pdf.iloc[i : i + 1].reset_index(drop=True)) for i in range(len(pdf))]
        return [c for cs, _ in parts for c in cs], [e for _, es in parts for e in es]

    def _apply(batches):
        for pdf in batches:
            asked = pdf[text_col].notna().to_numpy()
            cands, errors = _rows(pdf[asked].reset_index(drop=True)) if asked.any() else ([], [])
            cands, errors = iter(cands), iter(errors)
            res = pdf.copy()
            res["candidates"] = [next(cands) if a else [""] for a in asked]
            res["error"] = [next(errors) if a else None for a in asked]
            yield res

    return src.mapInPandas(_apply, schema).withColumn(out, F.element_at("candidates", 1))


def _generate(df, key, text_col, max_len, min_len, generator, params_cols, out, passthrough=()):
    """key + passthrough + ``out`` + ``error`` (NULL for the stand-in); a row
    that failed has no ``out``."""
    if generator is None:
        return extractive(df, [key, *passthrough], text_col, max_len, min_len, out).withColumn("error", F.lit(None).cast("string"))
    g = run_generator(df, key, text_col, generator, params_cols, out, passthrough)
    return g.select(key, *passthrough, F.when(F.col("error").isNull(), F.col(out)).alias(out), "error")


# ------------------------------------------------------------ long paths --
def decode_params(max_len, min_len, length_penalty, num_beams, second_pass: bool = False, text=None, model: str | None = None) -> Column:
    """K2/K4 decode settings handed to a plug-in generator (column ``_gp``):
    the preset lengths, penalty and beams with early stopping, and for the
    hierarchical second summary pass also temperature 0.3, no-repeat 4-grams
    and repetition penalty 2.5; the terms the model must not put out (I6)
    and, given the text, the prompt for the model (I7).  The extractive
    stand-in uses the lengths."""
    prompt = F.lit(None) if text is None else X.summary_prompt(text, F.lit(model or ""))
    def lit_or_col(v, t):
        return (F.col(v) if isinstance(v, str) else F.lit(v)).cast(t)

    return F.struct(
        lit_or_col(max_len, "int").alias("max_length"),
        lit_or_col(min_len, "int").alias("min_length"),
        lit_or_col(length_penalty, "double").alias("length_penalty"),
        lit_or_col(num_beams, "int").alias("num_beams"),
        F.lit(True).alias("early_stopping"),
        (F.lit(S.SECOND_PASS_TEMPERATURE) if second_pass else F.lit(None)).cast("double").alias("temperature"),
        (F.lit(S.SECOND_PASS_NO_REPEAT_NGRAM) if second_pass else F.lit(None)).cast("int").alias("no_repeat_ngram_size"),
        (F.lit(S.SECOND_PASS_REPETITION_PENALTY) if second_pass else F.lit(None)).cast("double").alias("repetition_penalty"),
        F.array(*[F.lit(t) for t in S.BANNED_TERMS]).alias("banned_terms"),
        prompt.cast("string").alias("prompt"),
    )


def _pieces(docs, key, text_col, is_long: Column, chunk_tokens: int) -> DataFrame:
    """One row per text to generate from: the chunks of long documents (K1),
    the whole text of the others as chunk 0, and a NULL text for a document
    without a word.  Output: key, path, chunk_no, piece.  One scan."""
    w = docs.select(key, F.col(text_col).alias("_t"), X.words(text_col).alias("_w"))
    w = w.select(key, "_t", "_w", F.when(is_long, "long").otherwise("direct").alias("path"))
    parts = F.when(F.col("path") == "long", chunk_texts(F.col("_w"), chunk_tokens)).when(F.size("_w") > 0, F.array("_t"))
    x = w.select(key, "path", F.posexplode_outer(parts).alias("chunk_no", "piece"))
    return x.withColumn("chunk_no", F.coalesce("chunk_no", F.lit(0)))


def _merged(parts: DataFrame, keys: list[str], text_col: str, out: str) -> DataFrame:
    """K3 with its failures: pieces joined in chunk order with one space,
    ``failed_chunks`` and the first ``error``.  The merged text of a document
    with failed chunks lacks them, which ``failed_chunks`` says."""
    g = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("chunk_no").alias("p"), F.col(text_col).alias("t")))).alias("_xs"),
        F.count("error").alias("failed_chunks"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_no"))).alias("error"),
    )
    return g.select(*keys, F.array_join(F.transform("_xs", lambda x: x["t"]), " ").alias(out), "failed_chunks", "error")


def _second_pass(merged, key, max_len, min_len, generator, length_penalty, num_beams, keep, model=None) -> DataFrame:
    """K4 over the merged text of the long documents; the others pass.  Adds
    ``summary`` and takes a failure of this pass into ``error``."""
    text = F.when((F.col("path") == "long") & (F.col("_merged") != ""), F.col("_merged"))
    m = merged.withColumn("_second", text).withColumn("_first_error", F.col("error")).drop("error")
    m = m.withColumn("_gp", decode_params(max_len, min_len, length_penalty, num_beams, second_pass=True, text="_second", model=model))
    f = _generate(m, key, "_second", max_len, min_len, generator, ["_gp"], "_final", passthrough=(*keep, "_merged", "_second", "failed_chunks", "_first_error"))
    # a second pass that failed has no text; its error says so
    done = F.when(F.col("_second").isNull(), F.col("_merged")).otherwise(F.col("_final"))
    return f.withColumn("summary", X.strip_unwanted_prefixes(done)).withColumn("error", F.coalesce("_first_error", "error"))


def _first_pass(docs, key, text_col, is_long, max_len, min_len, generator, chunk_tokens, length_penalty, num_beams, model=None) -> DataFrame:
    """K1 -> K2 -> K3: pieces generated where their document was read, then
    one shuffle of the short outputs.  Output: key, path, _merged,
    failed_chunks, error."""
    x = _pieces(docs, key, text_col, is_long, chunk_tokens).withColumn(
        "_cid", F.concat_ws(":", F.col(key).cast("string"), F.col("chunk_no").cast("string"))
    ).withColumn("_gp", decode_params(max_len, min_len, length_penalty, num_beams, text="piece", model=model))
    per_piece = _generate(x, "_cid", "piece", max_len, min_len, generator, ["_gp"], "_g", passthrough=(key, "path", "chunk_no"))
    return _merged(per_piece, [key, "path"], "_g", "_merged")


def summarize(
    docs: DataFrame,
    key: str,
    text_col: str,
    max_len: int = S.DEFAULT_SUMMARY_PARAMS[0],
    min_len: int = S.DEFAULT_SUMMARY_PARAMS[1],
    generator: Generator | None = None,
    chunk_tokens: int = S.CHUNK_TOKENS,
    length_penalty: float = S.DEFAULT_SUMMARY_PARAMS[2],
    num_beams: int = S.DEFAULT_SUMMARY_PARAMS[3],
    model: str | None = None,
) -> DataFrame:
    """K1 -> K2 -> K3 -> K4 -> I5 for every document: chunk, generate per
    chunk, merge in chunk order, generate again over the merged text (second
    pass decode settings), strip the unwanted prefixes.  Output: key,
    summary, failed_chunks, error."""
    m = _first_pass(docs, key, text_col, F.size("_w") > 0, max_len, min_len, generator, chunk_tokens, length_penalty, num_beams, model)
    out = _second_pass(m, key, max_len, min_len, generator, length_penalty, num_beams, (), model)
    return out.select(key, "summary", "failed_chunks", "error")


def paraphrase_long(
    docs: DataFrame,
    key: str,
    text_col: str,
    max_len: int = S.DEFAULT_PARAPHRASE_PARAMS[0],
    min_len: int = S.DEFAULT_PARAPHRASE_PARAMS[1],
    generator: Generator | None = None,
    chunk_tokens: int = S.CHUNK_TOKENS,
    length_penalty: float = S.DEFAULT_PARAPHRASE_PARAMS[2],
    num_beams: int = S.DEFAULT_PARAPHRASE_PARAMS[3],
) -> DataFrame:
    """K1 -> K2 -> K3 for paraphrases (no second pass).  Output: key,
    paraphrase, failed_chunks, error."""
    m = _first_pass(docs, key, text_col, F.size("_w") > 0, max_len, min_len, generator, chunk_tokens, length_penalty, num_beams)
    return m.select(key, F.col("_merged").alias("paraphrase"), "failed_chunks", "error")


def route_summaries(
    docs: DataFrame, key: str, text_col: str, max_len: int, min_len: int, generator: Generator | None = None,
    length_penalty: float = 1.0, num_beams: int = 3, model: str | None = None,
) -> DataFrame:
    """K5: direct generation under 500 words, the long path otherwise.  One
    scan: a direct document is its own only chunk, and only long documents
    get the second pass.  Output: key, path, summary, failed_chunks, error."""
    is_long = X.summary_route(F.size("_w")) == "long"
    m = _first_pass(docs, key, text_col, is_long, max_len, min_len, generator, S.CHUNK_TOKENS, length_penalty, num_beams, model)
    out = _second_pass(m, key, max_len, min_len, generator, length_penalty, num_beams, ("path",), model)
    return out.select(key, "path", "summary", "failed_chunks", "error")


def route_paraphrases(
    docs: DataFrame, key: str, text_col: str, max_len: int, min_len: int, generator: Generator | None = None,
    length_penalty: float = 1.0, num_beams: int = 4,
) -> DataFrame:
    """K5 for paraphrases: direct generation up to 100 words, the chunked
    path (no second pass, no prefix clean-up) otherwise.  Output: key, path,
    paraphrase, failed_chunks, error."""
    is_long = X.paraphrase_route(F.size("_w")) == "long"
    m = _first_pass(docs, key, text_col, is_long, max_len, min_len, generator, S.CHUNK_TOKENS, length_penalty, num_beams)
    return m.select(key, "path", F.col("_merged").alias("paraphrase"), "failed_chunks", "error")


def preset_sweep(docs: DataFrame, key: str, text_col: str, generator: Generator | None = None, model: str | None = None) -> DataFrame:
    """Every document under the short / medium / long presets; the long
    preset takes the chunked path when the text exceeds one chunk.  One scan:
    a row per whole text and, for long texts, per chunk.  The stand-in scores
    a row's sentences once for all presets; a plug-in generator gets one call
    per (row, preset) with that preset's decode settings.  Output: key,
    preset, summary, failed_chunks, error."""
    names = [p[0] for p in S.SUMMARY_PRESETS]
    w = docs.select(key, F.col(text_col).alias("_t"), X.words(text_col).alias("_w"))
    w = w.select(key, "_t", "_w", (F.size("_w") > S.CHUNK_TOKENS).alias("_long"))
    whole = F.array(F.struct(F.lit(-1).alias("chunk_no"), F.when(F.size("_w") > 0, F.col("_t")).alias("piece")))
    parts = F.transform(chunk_texts(F.col("_w"), S.CHUNK_TOKENS), lambda t, i: F.struct(i.alias("chunk_no"), t.alias("piece")))
    x = w.select(key, "_long", F.explode_outer(F.when(F.col("_long"), F.concat(whole, parts)).otherwise(whole)).alias("_p"))
    x = x.select(key, "_long", F.col("_p.chunk_no").alias("chunk_no"), F.col("_p.piece").alias("piece"))
    # the whole text serves every preset but the long one of a long text
    wanted = F.when(F.col("chunk_no") >= 0, F.col("preset") == "long").otherwise(~(F.col("_long") & (F.col("preset") == "long")))
    if generator is None:
        x = x.select(key, "_long", "chunk_no", _extractive_multi_udf(F.col("piece")).alias("_outs"))
        x = x.select(key, "_long", "chunk_no", F.posexplode_outer("_outs").alias("_i", "_g")).filter(F.col("_i").isNotNull())
        x = x.withColumn("preset", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)).withColumn("error", F.lit(None).cast("string"))
        g = x.filter(wanted).select(key, "preset", "_long", "chunk_no", "_g", "error")
    else:
        presets = F.array(*[
            F.struct(F.lit(n).alias("preset"), F.lit(m).alias("max_len"), F.lit(k).alias("min_len"), F.lit(a).cast("double").alias("lp"), F.lit(b).alias("nb"))
            for n, m, k, a, b in S.SUMMARY_PRESETS
        ])
        x = x.select("*", F.explode(presets).alias("p")).select(key, "_long", "chunk_no", "piece", "p.*").filter(wanted)
        x = x.withColumn("_sk", F.concat_ws(":", F.col(key).cast("string"), "preset", F.col("chunk_no").cast("string")))
        x = x.withColumn("_gp", decode_params("max_len", "min_len", "lp", "nb", text="piece", model=model))
        g = _generate(x, "_sk", "piece", "max_len", "min_len", generator, ["_gp"], "_g", passthrough=(key, "preset", "_long", "chunk_no"))
    g = g.withColumn("path", F.when(F.col("chunk_no") >= 0, "long").otherwise("direct"))
    m = _merged(g, [key, "preset", "path"], "_g", "_merged")
    mx, mn, lp, nb = [(m, n, a, b) for p, m, n, a, b in S.SUMMARY_PRESETS if p == "long"][0]
    out = _second_pass(m, key, mx, mn, generator, lp, nb, ("preset", "path"), model)
    return out.select(key, "preset", "summary", "failed_chunks", "error")


# -------------------------------------------------------- paraphrase jobs --
def expand_levels(df: DataFrame) -> DataFrame:
    """One row per (row, level) — a literal array exploded, no join."""
    return df.withColumn("level", F.explode(F.array(*[F.lit(level) for level in S.LEVELS])))


def fill_levels(rows: DataFrame, key: str, text_col: str = "original", generator: Generator | None = None) -> DataFrame:
    """K6/K7: ``generated_<level>`` for each row and the 3 levels, the first
    cleaned candidate each, beside the row's own columns (``original`` and
    ``reference`` stay, so the result can be written as the wide CSV).
    Failed generations keep their message in ``error_<level>`` and leave the
    text NULL (K9).  A row stays one row: no level is exploded or shuffled
    back.  The stand-in ignores the level, so it runs once per row."""
    x = rows
    if generator is None:
        # one call for the row: the stand-in has no level setting
        g = extractive(x, list(rows.columns), text_col, S.BATCH_FILL_MAX_NEW_TOKENS, 0, "_g")
        first = F.element_at(X.clean_candidates(F.array("_g"), F.col(text_col)), 1)
        return g.select(
            *rows.columns,
            *[c for level in S.LEVELS for c in (first.alias(f"generated_{level}"), F.lit(None).cast("string").alias(f"error_{level}"))],
        )
    for level in S.LEVELS:
        keep = [c for c in x.columns if c not in ("level", "gp")]
        y = generation_params(x.withColumn("level", F.lit(level)), "level", None, None, S.BATCH_FILL_N, S.BATCH_FILL_MAX_NEW_TOKENS)
        g = run_generator(y, key, text_col, generator, ["gp", "level"], "_g", keep)
        cands = X.clean_candidates(F.coalesce("candidates", F.array().cast("array<string>")), F.col(text_col))
        first = F.when(F.col("error").isNull(), F.element_at(cands, 1))
        x = g.select(*keep, first.alias(f"generated_{level}"), F.col("error").alias(f"error_{level}"))
    return x


def paraphrase_response(requests: DataFrame, key: str = "rid", generator: Generator | None = None) -> DataFrame:
    """K8: valid request -> level preset -> params -> generate -> clean ->
    response row (paraphrases, model_name, level, generation_params)."""
    valid, _rejected = split_valid(requests)
    p = generation_params(valid, "level")
    p = p.withColumn("_mx", F.col("gp.max_new_tokens")).withColumn("_mn", F.lit(0))
    keep = (key, "text", "model_name", "level", "gp")
    if generator is None:
        # the stand-in's i-th candidate may be i times as long
        cands = _extractive_candidates_udf(F.col("text"), F.col("_mx"), F.col("_mn"), F.col("gp.num_return_sequences"))
        g = p.select(*keep, cands.alias("_cands"))
    else:
        g = run_generator(p, key, "text", generator, ["gp"], "_g", keep).withColumn("_cands", F.col("candidates"))
    return g.select(
        key,
        X.clean_candidates(F.coalesce("_cands", F.array().cast("array<string>")), F.col("text")).alias("paraphrases"),
        "model_name",
        "level",
        F.col("gp").alias("generation_params"),
    )
