"""The corpus pipeline: language ID, near-duplicates, repeated passages,
personal data, packing.

Every stage takes all rows that the stage before it kept and returns the
columns of ``documents``; the last returns the packed pieces.  Stages write
Parquet into the shared folder and the next one reads it.

Null or letterless texts go in the first stage.  Rows without an id, and rows
that share one, are rows like any other: of a group of near-duplicates the one
with the smallest id stays (no id is the smallest, and of equal ids the row
read first).  Further columns, whatever their names, are carried along; an
empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselab.llm import langid, minhash, packing, pii, suffix_dedup
from proselab.llm.common import held_out, read, saved

#: a language is accepted from this posterior on
LEAST_SCORE = 0.5
#: words a shingle, similarity in per cent
SHINGLE, SIMILAR = 5, 80
VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k.json", 0, 2048


def _aside(docs: DataFrame) -> DataFrame:
    """All columns but id and text under names that clash with nothing."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)))


def _back(df: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of ``docs`` again; with a new text, ``n_chars`` follows."""
    out = []
    for i, c in enumerate(docs.columns):
        new = F.col(text or "text") if c == "text" else F.col("doc_id" if c == "doc_id" else f"__c{i}")
        if text and c == "n_chars":
            new = F.length(text).cast(docs.schema[c].dataType)
        out.append(new.alias(c))
    return df.select(*out)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least 0.5."""
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    plain = _aside(docs)
    told = langid.predict(plain, model, tuple(plain.columns))
    if not model[0]:  # nothing to learn from: nothing to reject by but letters
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return _back(told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates.  Documents are
    told apart by a row id of their own, so rows that share a ``doc_id`` are
    rows like any other.  The id is a row's place in the scan: a stage's input
    is a written table, whose splits and order are the same at every reading."""
    rows = _aside(docs).withColumn("__row", F.monotonically_increasing_id())
    marks = minhash.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), SHINGLE, SIMILAR)
    groups = marks.select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__row", "doc_id"), "__row")
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
    return _back(rows.join(first.select("first.__row"), "__row", "left_semi"), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document holds; documents of
    which nothing is left go."""
    plain = _aside(docs)
    keep = tuple(c for c in plain.columns if c != "text")
    out = suffix_dedup.dedup(plain, keep, as_text=True)
    left = out.filter("n_removed = 0 or trim(kept_text) <> ''")
    return _back(left, docs, "kept_text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    return _back(pii.mask(_aside(docs)).withColumnRenamed("text", "__masked"), docs, "__masked")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.pack(docs, VOCABULARY, END_ID, CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the sorts nor the learned and packed stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
