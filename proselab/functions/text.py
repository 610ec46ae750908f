"""Column -> Column text helpers (I1-I19, G1).  All native Spark
expressions: they stay inside whole-stage codegen, no Python per row.

Whitespace follows Python's ``str.strip`` / ``str.split`` (Unicode White_Space),
not SQL ``trim`` (spaces only).
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# Python's whitespace set (``str.isspace``) as a regex class.  Java's
# ``Character.isWhitespace`` plus the four no-break / next-line spaces it
# leaves out is exactly that set (checked over the whole BMP in the tests),
# and one predicate per character is ~5x faster than a list of ranges.
WS = r"[\p{javaWhitespace}\x{85}\x{a0}\x{2007}\x{202f}]"
# The same set spelled as explicit code points, for regex engines without
# ``\p{javaWhitespace}`` (the SQL oracles).
WS_PORTABLE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# Starts only where a run of whitespace starts, so a run inside the text is
# read once, not once from each of its characters.
TRAILING_WS = rf"(?<!{WS}){WS}+\z"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collated(c: str | Column, collation: str | None) -> Column:
    """A key as it is compared: byte by byte, or under ``collation``
    (``UTF8_LCASE``: case does not count)."""
    return F.collate(_c(c), collation) if collation else _c(c)


def strip_ws(c: str | Column) -> Column:
    """``str.strip()``.  The regex only runs when the first or the last
    character is whitespace (otherwise there is nothing to strip), so long
    texts are not scanned end to end."""
    c = _c(c)
    edge = F.substring(c, 1, 1).rlike(f"^{WS}$") | F.substring(c, -1, 1).rlike(f"^{WS}$")
    return F.when(edge, F.regexp_replace(c, f"^{WS}+|{TRAILING_WS}", "")).otherwise(c)


def strip_lower(c: str | Column) -> Column:
    """``s.strip().lower()``."""
    return F.lower(strip_ws(c))


NON_WS = "[^" + WS[1:-1] + "]"


def words(c: str | Column) -> Column:
    """``str.split()`` — the runs of non-whitespace characters."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(f"{NON_WS}+"), 0)


def word_count(c: str | Column) -> Column:
    """``len(s.split())`` (NULL counts as empty), counted without
    materialising the words."""
    return F.regexp_count(F.coalesce(_c(c), F.lit("")), F.lit(f"{NON_WS}+"))


def summary_route(n_words: Column) -> Column:
    """Summaries go direct below 500 words, else the chunked path."""
    return F.when(n_words < S.SUMMARY_DIRECT_MAX_WORDS_EXCL, "direct").otherwise("long")


def paraphrase_route(n_words: Column) -> Column:
    """Paraphrases go direct up to 100 words, else the chunked path."""
    return F.when(n_words <= S.PARAPHRASE_DIRECT_MAX_WORDS, "direct").otherwise("long")


def preview(c: str | Column, n: int = S.PREVIEW_CHARS) -> Column:
    """I4: first ``n`` characters plus '...' when longer (a display feature)."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def prefix_pattern() -> str:
    """All clean-up steps as one anchored regex.  Each step is optional and
    possessive: the prefix (ASCII letters in any case), whitespace, at most
    one ':' or '-', whitespace.  Nothing after the prefixes is read."""
    tail = f"{WS}*+(?:[:\\-]{WS}*+)?+"
    return "^" + "".join(f"(?:(?i:{p}){tail})?+" for p in S.UNWANTED_PREFIXES)


def strip_unwanted_prefixes(c: str | Column) -> Column:
    """Remove 'conclusion:', 'conclusion', 'summary:', 'summary',
    'in conclusion' — in that order, once each, case-insensitive, not word
    bounded; after a hit strip, then drop one leading ':' or '-' and strip.
    A text without any of the prefixes is unchanged.  Linear in the text."""
    c = _c(c)
    hit = c.rlike("^(?i:" + "|".join(S.UNWANTED_PREFIXES) + ")")
    return F.when(hit, F.regexp_replace(c, f"{prefix_pattern()}|{TRAILING_WS}", "")).otherwise(c)


def banned_hits(c: str | Column) -> Column:
    """Banned terms occurring (case-insensitive substring) in the text."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    # plain column expressions (no lambda): codegen computes lower() once
    return F.array_compact(F.array(*[F.when(F.instr(low, t) > 0, F.lit(t)) for t in S.BANNED_TERMS]))


def without_banned(df, text_col: str, keep_banned: bool = False):
    """I6 keep/drop filter: rows whose text contains no banned term (or,
    with ``keep_banned``, only the rows that do).  A narrow filter."""
    hit = F.size(banned_hits(text_col)) > 0
    return df.filter(hit if keep_banned else ~hit)


def summary_prompt(text: str | Column, model_path: str | Column) -> Column:
    """The long instruction prefix only for a 'Pegasus' model path
    (case-sensitive test, as in the reference)."""
    return F.when(
        F.instr(_c(model_path), "Pegasus") > 0, F.concat(F.lit(S.PEGASUS_PROMPT), _c(text))
    ).otherwise(_c(text))


def reference_prompt(task: str | Column, text: str | Column) -> Column:
    """Reference-generator prompt by task."""
    return F.when(_c(task) == "summary", F.concat(F.lit(S.SUMMARY_PROMPT), _c(text))).otherwise(
        F.concat(F.lit(S.PARAPHRASE_PROMPT), _c(text))
    )


def clean_candidates(cands: str | Column, source: str | Column) -> Column:
    """I8 + G1: strip each candidate, drop case-insensitive copies of the
    (unstripped) source, keep first occurrences in order, fall back to
    ``[source]`` when nothing is left."""
    src = _c(source)
    stripped = F.transform(_c(cands), lambda x: strip_ws(x))
    kept = F.array_distinct(F.filter(stripped, lambda x: F.lower(x) != F.lower(src)))
    return F.when(F.size(kept) == 0, F.array(src)).otherwise(kept)


def model_repo(name: str | Column) -> Column:
    """I9: 't5' / 'bart' (any case) -> repository id, else unchanged."""
    low = F.lower(_c(name))
    out = _c(name)
    for alias, repo in reversed(S.MODEL_ALIASES):
        out = F.when(low == alias, F.lit(repo)).otherwise(out)
    return out


def fallback_text(generated: str | Column, original: str | Column) -> Column:
    """Stripped generated text, else stripped original ('' if both empty)."""
    g = strip_ws(F.coalesce(_c(generated), F.lit("")))
    o = strip_ws(F.coalesce(_c(original), F.lit("")))
    return F.when(g != "", g).otherwise(o)


INT_TEXT = f"^{WS}*[+-]?[0-9]+{WS}*$"
INT_TEXT_PORTABLE = f"^{WS_PORTABLE}*[+-]?[0-9]+{WS_PORTABLE}*$"


def lenient_int(c: str | Column, default: int = S.DEFAULT_AGE) -> Column:
    """``int(x)`` with a default for missing or unparsable values; a
    number beyond 32 bits is no age and gets the default as well."""
    c = _c(c)
    number = F.when(c.rlike(INT_TEXT), strip_ws(c).try_cast("int"))
    return F.coalesce(number, F.lit(default))


def lang_code(c: str | Column) -> Column:
    """Language name -> code (NULL for unknown)."""
    m = F.create_map(*[F.lit(x) for kv in S.LANG_CODES for x in kv])
    return F.element_at(m, _c(c))


def capitalize(c: str | Column) -> Column:
    """``str.capitalize()`` — first character upper, the rest lower."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (SQL ``greatest``/``least``
    would skip the NULL and return a bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def display_fixed(x: Column, decimals: int) -> Column:
    """I14 display form (string with fixed decimals)."""
    return F.format_string(f"%.{decimals}f", x)
