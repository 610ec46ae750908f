import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from proselab.operators import readability as RD

ALPHABET = "aeiouybcdfgklmnrstxz AEIOUY.!?,;\n\t-'0123é"


def _py_counts(text):
    low = text.lower()
    words = re.findall(r"[a-z]+", low)
    syl = [max(1, len(re.findall(r"[aeiouy]+", w))) for w in words]
    pieces = [p for p in re.split(r"[.!?]+", text) if re.search(r"[^ \t\n\x0b\f\r]", p)]
    return len(words), max(1, len(pieces)), sum(syl), sum(1 for s in syl if s >= 3)


@given(st.lists(st.text(alphabet=ALPHABET, max_size=300), min_size=1, max_size=12))
@settings(max_examples=6, deadline=None)
def test_counts_match_python_rules(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r["k"]: (r["n_words"], r["n_sentences"], r["n_syllables"], r["n_complex"]) for r in RD.counts(df, "text").collect()}
    for k, t in enumerate(texts):
        assert got[k] == _py_counts(t), t


def test_level_scores_bounded(spark):
    texts = ["Go. Run. Eat.", "Incomprehensibility characterizes institutionalization. " * 5, "", "a b c d e f g h i j k."]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    rows = RD.levels(df, "text").collect()
    for r in rows:
        if r["n_words"] == 0:
            assert r["beginner"] is None and r["level"] is None
            continue
        for c in ("beginner", "intermediate", "advanced"):
            assert 0.0 <= r[c] <= 100.0
        w, s, syl = r["n_words"], r["n_sentences"], r["n_syllables"]
        assert math.isclose(r["flesch_reading_ease"], 206.835 - 1.015 * w / s - 84.6 * syl / w)
