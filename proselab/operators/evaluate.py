"""Evaluation pipeline.

Wide evaluation rows (original, reference, one generated text per level)
become long ``(row, level)`` pairs with a literal-array explode (no join),
blank references are skipped, the generated text falls back to the
original, ROUGE is computed per pair and averaged per level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from . import metrics as M


def level_pairs(rows: DataFrame, key: str = "pid") -> DataFrame:
    """C7 + B7 + I10: (key, level, original, reference, generated) for every
    row whose stripped reference is non-empty and each of the 3 levels."""
    ref = X.strip_ws(F.coalesce(F.col("reference"), F.lit("")))
    levels = F.array(
        *[F.struct(F.lit(level).alias("level"), F.col(f"generated_{level}").alias("g")) for level in S.LEVELS]
    )
    x = rows.select(key, F.coalesce("original", F.lit("")).alias("original"), ref.alias("reference"), F.explode(levels).alias("_l"))
    return x.filter(F.col("reference") != "").select(
        key,
        F.col("_l.level").alias("level"),
        "original",
        "reference",
        X.fallback_text(F.col("_l.g"), F.col("original")).alias("generated"),
    )


def eval_rows(rows: DataFrame, key: str = "pid", stem: bool = True) -> DataFrame:
    """Per-row scores by level (reference vs generated), the pair
    columns carried through the scoring (no join back)."""
    p = level_pairs(rows, key)
    s = M.score_pairs(p, [key, "level"], "generated", "reference", stem, keep=("original", "reference", "generated"))
    return s.select(key, "level", "original", "reference", "generated", "rouge1_f", "rouge2_f", "rougeL_f")


def level_summary(scored: DataFrame) -> DataFrame:
    """Mean ROUGE-1/2/L F and count for each of the 3 levels; a level
    without rows reports zeros.  The literal 3-row level frame has a fixed
    size, so broadcasting it is safe."""
    spark = scored.sparkSession
    levels = spark.createDataFrame([(level, i) for i, level in enumerate(S.LEVELS)], "level string, level_order int")
    agg = scored.groupBy("level").agg(
        F.avg("rouge1_f").alias("rouge1_f_mean"),
        F.avg("rouge2_f").alias("rouge2_f_mean"),
        F.avg("rougeL_f").alias("rougeL_f_mean"),
        F.count(F.lit(1)).alias("count"),
    )
    return (
        agg.join(F.broadcast(levels), "level", "right")
        .select(
            "level",
            *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("rouge1_f_mean", "rouge2_f_mean", "rougeL_f_mean")],
            F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
            "level_order",
        )
        .orderBy("level_order")
        .drop("level_order")
    )


def first_match(inputs: DataFrame, key: str, text_col: str, dataset: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """C4: each input matched to the FIRST dataset row (by ``ord``) whose
    stripped ``input_text`` equals the stripped input; unmatched inputs are
    kept with ``matched = false``.  ``keep`` input columns are carried along.

    No text is ever a grouping, join or sort key: both sides are keyed by the
    SHA-256 of the stripped text, the dataset is reduced to the smallest
    ``ord`` per digest (combined before the shuffle), the firsts' targets are
    fetched by ``ord``, and inputs meet them on the digest.  Inputs are never
    dealt on ``ord``, which all the unmatched ones lack: they would go to one
    task."""
    rows = dataset.select("ord", "input_text", "target_text").na.drop(subset=["input_text", "target_text"])
    firsts = rows.groupBy(F.sha2(X.strip_ws("input_text"), 256).alias("_d")).agg(F.min("ord").alias("_ord"))
    i = inputs.select(key, *keep, F.sha2(X.strip_ws(F.coalesce(text_col, F.lit(""))), 256).alias("_d"))
    targets = firsts.join(rows.select(F.col("ord").alias("_o"), "target_text"), F.col("_ord") == F.col("_o"))
    j = i.join(targets, "_d", "left")
    return j.select(
        key,
        *keep,
        F.col("_ord").isNotNull().alias("matched"),
        F.col("_ord").alias("dataset_ord"),
        F.col("target_text").alias("reference"),
    )


def metric_card(
    texts: DataFrame, dataset: DataFrame, stem: bool = True, vectors: DataFrame | None = None, token_vectors: DataFrame | None = None
) -> DataFrame:
    """J12 over ALL history rows at once: match each record's input to the
    dataset (C4), then BLEU-4 and ROUGE-1/2/L of reference vs the record's
    generated text, and, from given vectors of the records, the cosine
    (``vectors``: pid, u, v) and the soft match (``token_vectors``).
    Unmatched records get NULL scores (the reference refuses to score
    external inputs); so do records without vectors."""
    m = first_match(texts, "id", "input_text", dataset, keep=("content_text",))
    s = M.score_pairs(
        m, ["id"], "content_text", "reference", stem, bleu=True, keep=("matched", "dataset_ord"), active="matched"
    )
    names = ["rouge1_f", "rouge2_f", "rougeL_f", "bleu"]
    if vectors is not None:
        s = s.join(vectors.select(F.col("pid").alias("_v"), M.cosine("u", "v").alias("cosine")), F.col("id") == F.col("_v"), "left")
        names.append("cosine")
    if token_vectors is not None:
        soft = M.soft_match(token_vectors).select(F.col("pid").alias("_t"), "soft_p", "soft_r", "soft_f")
        s = s.join(soft, F.col("id") == F.col("_t"), "left")
        names += ["soft_p", "soft_r", "soft_f"]
    return s.select("id", "matched", "dataset_ord", *[F.when(F.col("matched"), F.col(c)).alias(c) for c in names])


def self_rouge(texts: DataFrame, key: str = "id", stem: bool = True) -> DataFrame:
    """ROUGE of a paraphrase against its own input (copy rate)."""
    p = texts.filter(F.col("content_type") == "paraphrase").select(key, "input_text", "content_text")
    return M.rouge_all(p, [key], "content_text", "input_text", stem)


def page_count(df: DataFrame, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """Row count and number of pages of ``page_size`` rows; an empty
    frame has 0 pages (the reference's formula would give 0 pages but a
    minimum page of 1)."""
    n = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return n.select(
        "total_rows",
        F.when(F.col("total_rows") == 0, F.lit(0))
        .otherwise(F.floor((F.col("total_rows") - 1) / page_size) + 1)
        .cast("long")
        .alias("pages"),
    )
