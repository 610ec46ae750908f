"""Registered readability queries (J8-J11, I15) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import readability as RD
from ..sources.tables import read_table
from .registry import oracle_of, register

_COUNTS_SQL = r"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws FROM documents),
c AS (
  SELECT doc_id,
         CAST(len(ws) AS BIGINT) AS n_words,
         CAST(greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'),
                                       lambda s: regexp_matches(s, '[^ \t\n\x0B\f\r]'))), 1) AS BIGINT) AS n_sentences,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')), 1))), 0) AS BIGINT) AS n_syllables,
         CAST(len(list_filter(ws, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')), 1) >= 3)) AS BIGINT) AS n_complex
  FROM w),
s AS (
  SELECT *,
         CASE WHEN n_words > 0 THEN 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words) END AS fre,
         CASE WHEN n_words > 0 THEN 0.4 * ((n_words / n_sentences) + 100.0 * (n_complex / n_words)) END AS fog,
         CASE WHEN n_words > 0 THEN CASE WHEN n_sentences >= 3 THEN 1.043 * sqrt(n_complex * (30.0 / n_sentences)) + 3.1291 ELSE 0.0 END END AS smog
  FROM c)"""


def _syllable_sql(word: str) -> str:
    """Syllables of a word: at each place, what stands before and after it is
    held against ``MARKS``, then the marked word's vowel runs are counted."""
    ends = lambda p: p.replace("<", "^").replace(">", "$")
    gone = "|".join(f"({ends(left)})#{mid}({ends(right)})" for left, mid, right in RD.MARKS if mid)
    cut = "|".join(f"({ends(left)})#({ends(right)})" for left, mid, right in RD.MARKS if not mid)
    at = f"{word}[:i - 1] || '#' || {word}[i:]"
    marked = (
        f"list_aggregate(list_transform(range(1, length({word}) + 1), lambda i:"
        f" CASE WHEN regexp_matches({at}, '{gone}') THEN 'H'"
        f" WHEN regexp_matches({at}, '{cut}') THEN 'H' || {word}[i] ELSE {word}[i] END), 'string_agg', '')"
    )
    return f"greatest(len(regexp_extract_all(regexp_replace({marked}, '([aeiouy])sm$', '\\1sym'), '[aeiouy]+')), 1)"


_SPELLING_SQL = (
    r"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws FROM documents),
each AS (SELECT word, CAST(count(*) AS BIGINT) AS n, doc_id FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY doc_id, word),
dict AS (SELECT word, """
    + _syllable_sql("word")
    + r""" AS syl FROM (SELECT DISTINCT word FROM each)),
per AS (SELECT doc_id, CAST(sum(n * syl) AS BIGINT) AS n_syllables,
               CAST(coalesce(sum(n) FILTER (WHERE syl >= 3), 0) AS BIGINT) AS n_complex
        FROM each JOIN dict USING (word) GROUP BY doc_id),
c AS (
  SELECT doc_id,
         CAST(len(ws) AS BIGINT) AS n_words,
         CAST(greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'),
                                       lambda s: regexp_matches(s, '[^ \t\n\x0B\f\r]'))), 1) AS BIGINT) AS n_sentences,
         coalesce(n_syllables, 0) AS n_syllables, coalesce(n_complex, 0) AS n_complex
  FROM w LEFT JOIN per USING (doc_id)),
"""
    + _COUNTS_SQL[_COUNTS_SQL.index("s AS (\n  SELECT *,") :]
)



def _r(c):
    return F.round(F.col(c), 6).alias(c)


@register(
    "readability",
    _COUNTS_SQL
    + """
SELECT doc_id, n_words, n_sentences, n_syllables, n_complex,
       CAST(round(fre, 6) AS DOUBLE) AS flesch_reading_ease, CAST(round(fog, 6) AS DOUBLE) AS gunning_fog,
       CAST(round(smog, 6) AS DOUBLE) AS smog_index
FROM s""",
)
def q_readability(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    s = RD.scores(docs, "text")
    return s.select(
        "doc_id", "n_words", "n_sentences", "n_syllables", "n_complex",
        _r("flesch_reading_ease"), _r("gunning_fog"), _r("smog_index"),
    )


@register(
    "readability_levels",
    _COUNTS_SQL
    + """,
b AS (SELECT doc_id, CASE WHEN fre IS NOT NULL THEN
                        (least(greatest(fre, 0), 100) + least(greatest((20 - fog) * 5, 0), 100)
                         + least(greatest((20 - smog) * 5, 0), 100)) / 3.0 END AS beg FROM s),
l AS (SELECT doc_id, CASE WHEN beg IS NOT NULL THEN least(greatest(beg, 0), 100) END AS beginner,
             CASE WHEN beg IS NOT NULL THEN least(greatest(100 - abs(50 - beg) * 2, 0), 100) END AS intermediate,
             CASE WHEN beg IS NOT NULL THEN least(greatest(100 - beg, 0), 100) END AS advanced FROM b)
SELECT doc_id, CAST(round(beginner, 6) AS DOUBLE) AS beginner, CAST(round(intermediate, 6) AS DOUBLE) AS intermediate,
       CAST(round(advanced, 6) AS DOUBLE) AS advanced,
       CASE WHEN beginner IS NULL THEN NULL
            WHEN beginner >= intermediate AND beginner >= advanced THEN 'Beginner'
            WHEN intermediate >= advanced THEN 'Intermediate' ELSE 'Advanced' END AS level
FROM l""",
)
def q_readability_levels(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    lv = RD.levels(docs, "text")
    return lv.select("doc_id", _r("beginner"), _r("intermediate"), _r("advanced"), "level")


@register("readability_spelling", oracle_of("readability").replace(_COUNTS_SQL, _SPELLING_SQL))
def q_readability_spelling(spark, d):
    s = RD.scores(read_table(spark, d, "documents").select("doc_id", "text"), "text", syllables="spelling")
    return s.select(
        "doc_id", "n_words", "n_sentences", "n_syllables", "n_complex",
        _r("flesch_reading_ease"), _r("gunning_fog"), _r("smog_index"),
    )


@register("readability_spelling_levels", oracle_of("readability_levels").replace(_COUNTS_SQL, _SPELLING_SQL))
def q_readability_spelling_levels(spark, d):
    lv = RD.levels(read_table(spark, d, "documents").select("doc_id", "text"), "text", syllables="spelling")
    return lv.select("doc_id", _r("beginner"), _r("intermediate"), _r("advanced"), "level")
