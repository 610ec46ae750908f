"""Readability scores and reading-level scores.

Counting rules (ours, documented; the dictionary-based syllable counts of
the reference's library cannot be reproduced offline):

* words: ``[a-z]+`` runs of the lower-cased text;
* sentences: non-blank pieces of ``split(text, '[.!?]+')``, at least 1;
* syllables of a word: number of ``[aeiouy]+`` runs, at least 1; with
  ``syllables="spelling"``, the runs left once the places of ``MARKS`` are taken
  out or cut apart: silent e (also before s, d and endings such as -ly), the
  syllable of -le and -re after a consonant, y between vowels, hiatus (cre-ate,
  ra-di-o, po-et), and a final -sm as one more.  These are rules of English
  spelling; words of other languages are counted by them too;
* complex / polysyllabic word: 3 or more syllables.

All native column expressions, one pass, no shuffle.  Texts with no word
get NULL scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import clamp


_V = "[aeiouy]"
_C = "[b-df-hj-np-tv-xz]"
# whole [a-z]+ words (not preceded / followed by a letter)
_CONSONANT_WORD = f"(?<![a-z]){_C}+(?![a-z])"


# a consonant after which a final e is silent; l and r count only after a vowel
# or one of themselves (whole, called), for ta-ble and a-cre have a syllable there
_MUTE = "[bcdfghjkmnpqstvwxyz]|[aeiouylr]l|[aeiouyr]r"

#: places in a word: what stands before, the letter that goes ("" to cut
#: between two letters), what follows; ``<`` and ``>`` are the word's ends
MARKS: list[tuple[str, str, str]] = [
    # silent e
    (_MUTE, "e", ">"),
    ("[bdfkmnprtvwy]|[aeiouylr]l|[pt]h", "e", "s>"),
    ("[bcfghjkmnpqsvwxyz]|[aeiouylr]l|[aeiouyr]r", "e", "d>"),
    ("[aeiouy][b-df-hj-np-tv-xz]|[aeiouy][b-df-hj-np-tv-xz][b-df-hj-km-np-qstv-xz]", "e", "(ly|less|ful|fully|ness)>"),
    ("[aeiouy][b-df-hj-km-np-tv-xz]", "e", "ments?>"),
    # -que, -gue: the u goes, its e is mute already
    ("[aeiouy]q|[aeiouy]g", "u", "es?>"),
    ("[aeiouy][qg]u", "e", "s?>"),
    # y between vowels is a consonant
    ("[aeiou]", "y", "[aeiou]"),
    # hiatus
    ("[abd-ru-z]i", "", "a([^g]|g[^e]|>)"),
    ("[cst]i", "", "at"),
    ("[bdfjkmpqrvwyz]i|<li|[aeiou]li", "", "o"),
    ("[a-z]i", "", "o>"),
    ("i", "", "u"),
    ("i", "", "et"),
    ("[abd-su-z]i|<sci", "", "en[ct]"),
    ("[aeiouy][b-df-hj-np-tv-xz]{1,3}i", "", "e(r|st)>"),
    ("i", "", "i"),
    ("[b-df-hj-np-tv-xz]y", "", "i"),
    ("[dhlnrt]e", "", "o([^u]|>)"),
    ("ne", "", "ou"),
    ("<ge", "", "o[glm]"),
    ("[aeiouy][b-df-hj-np-tv-xz]{1,3}e", "", "as?>"),
    ("cre", "", "at[ei]"),
    ("re", "", "ality"),
    ("the", "", "at"),
    ("[lnrst]e", "", "u[ms]>"),
    ("[be]e", "", "ing"),
    ("<re", "", "in"),
    ("[dn]e", "", "ity"),
    ("[b-fh-pr-z]u", "", "a"),
    ("[b-fh-pr-z]u", "", "e(l|nt|nc)"),
    ("[b-fh-pr-z]u", "", "o"),
    ("[lnr]u", "", "i(d|n|t[iy])"),
    ("po", "", "e[mt]"),
    ("[dg]o", "", "ing"),
    ("ro", "", "ic"),
    ("<co", "", "o(per|rd)"),
    ("a", "", "o"),
    ("[hrs]a", "", "ic"),
]


def _mark_pattern() -> str:
    """All of ``MARKS`` as one pattern over whole texts: only a letter that
    goes is matched, what stands around it is looked at.  A place is passed
    over by its own letters; the lists of neighbours are tried only at an e, u
    or y that may go and between two vowels, and by the letters there."""
    ends = lambda p: p.replace("<", "(?<![a-z])").replace(">", "(?![a-z])")
    gone = [
        mid + "(?:" + "|".join(f"(?={ends(right)})(?<=(?:{ends(left)}){mid})" for left, m, right in MARKS if m == mid) + ")"
        for mid in ("e", "u", "y")
    ]
    cuts = []
    for c in "aeiouy":  # by the letter before, then by the one after
        after = {d: [f"(?={ends(right)})(?<={ends(left)})" for left, m, right in MARKS if not m and left[-1] == c and right[0] == d] for d in "aeiou"}
        tries = "|".join(f"(?={d})(?:{'|'.join(found)})" for d, found in after.items() if found)
        cuts.append(f"(?<={c})(?:{tries})")
    return "(?=[aeiouy])(?:" + "|".join(gone) + f"|(?<=[aeiouy])(?=[aeiou])(?:{'|'.join(cuts)}))"


def _count(s: Column, pattern: str) -> Column:
    """Number of matches, counted without materialising them."""
    return F.regexp_count(s, F.lit(pattern))


def _by_spelling(df: DataFrame, low: Column, words: Column, sentences: Column) -> DataFrame:
    """The counts with ``syllables="spelling"``: every marked place becomes an
    H; each vowel run, and each final -sm, becomes one V (no other capital is
    left); consonants gone, a word is the run of its syllables."""
    marked = F.regexp_replace(low, _mark_pattern(), "H")
    runs = F.regexp_replace(marked, f"{_V}+|(?<={_V}s)(?=m(?![a-zH]))", "V")
    left = "__syllables"
    while left in df.columns:
        left += "_"
    x = df.select(
        *df.columns, words.alias("n_words"), sentences.alias("n_sentences"), F.regexp_replace(runs, "[b-df-hj-np-tv-xzH]+", "").alias(left)
    )
    s, n = F.col(left), F.col("n_words")
    return x.select(
        *df.columns,
        "n_words",
        "n_sentences",
        (_count(s, "V") + n - _count(s, "V+")).cast("long").alias("n_syllables"),
        _count(s, "V{3,}").cast("long").alias("n_complex"),
    )


def counts(df: DataFrame, text_col: str, syllables: str = "runs") -> DataFrame:
    """Adds n_words, n_sentences, n_syllables, n_complex; ``syllables`` is
    "runs" or "spelling" (module docstring).

    Counted with regex matches over the whole lower-cased text (no
    per-word lambda): syllables = vowel runs + words without a vowel run
    (each word counts at least 1); complex words = words with at least three
    vowel runs.  Every pattern is a loop over single characters: linear in
    the text, and no word is too long for the regex engine."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(c)
    # without blanks, a piece between end marks is non-blank if it is there
    sentences = F.greatest(_count(F.regexp_replace(c, r"[\t\n\x0B\f\r ]+", ""), "[^.!?]+"), F.lit(1))
    words, sentences = _count(low, "[a-z]+").cast("long"), sentences.cast("long")
    if syllables == "spelling":
        return _by_spelling(df, low, words, sentences)
    if syllables != "runs":
        raise ValueError(f"syllables: runs or spelling, not {syllables}")
    # each vowel run as one V (no capital is left in ``low``), consonants gone:
    # a word is the run of its syllables
    left = F.regexp_replace(F.regexp_replace(low, f"{_V}+", "V"), f"{_C}+", "")
    return df.select(
        *df.columns,
        words.alias("n_words"),
        sentences.alias("n_sentences"),
        (_count(low, f"{_V}+") + _count(low, _CONSONANT_WORD)).cast("long").alias("n_syllables"),
        _count(left, "V{3,}").cast("long").alias("n_complex"),
    )


def scores(df: DataFrame, text_col: str, syllables: str = "runs") -> DataFrame:
    """J8 Flesch reading ease, J9 Gunning fog, J10 SMOG (0 below 3
    sentences)."""
    x = counts(df, text_col, syllables)
    w, s, syl, cx = (F.col(k).cast("double") for k in ("n_words", "n_sentences", "n_syllables", "n_complex"))
    has = F.col("n_words") > 0
    flesch = F.lit(S.FLESCH_BASE) - F.lit(S.FLESCH_WPS) * (w / s) - F.lit(S.FLESCH_SPW) * (syl / w)
    fog = F.lit(S.FOG_FACTOR) * ((w / s) + F.lit(100.0) * (cx / w))
    smog = F.when(
        F.col("n_sentences") >= 3, F.lit(S.SMOG_FACTOR) * F.sqrt(cx * (F.lit(float(S.SMOG_SENTENCES)) / s)) + F.lit(S.SMOG_BASE)
    ).otherwise(F.lit(0.0))
    return x.select(
        *x.columns,
        F.when(has, flesch).alias("flesch_reading_ease"),
        F.when(has, fog).alias("gunning_fog"),
        F.when(has, smog).alias("smog_index"),
    )


def _norm_fog_smog(x: Column) -> Column:
    return clamp((F.lit(20.0) - x) * F.lit(5.0))


def levels(df: DataFrame, text_col: str, syllables: str = "runs") -> DataFrame:
    """Beginner / intermediate / advanced scores in [0, 100] and the
    best-fitting level (ties resolved in that order)."""
    x = scores(df, text_col, syllables)
    beg = (clamp(F.col("flesch_reading_ease")) + _norm_fog_smog(F.col("gunning_fog")) + _norm_fog_smog(F.col("smog_index"))) / F.lit(3.0)
    x = x.withColumn("beginner", clamp(beg))
    x = x.withColumn("intermediate", clamp(F.lit(100.0) - F.abs(F.lit(50.0) - beg) * F.lit(2.0)))
    x = x.withColumn("advanced", clamp(F.lit(100.0) - beg))
    best = (
        F.when((F.col("beginner") >= F.col("intermediate")) & (F.col("beginner") >= F.col("advanced")), "Beginner")
        .when(F.col("intermediate") >= F.col("advanced"), "Intermediate")
        .otherwise("Advanced")
    )
    return x.withColumn("level", F.when(F.col("beginner").isNotNull(), best))
