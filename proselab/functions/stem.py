"""Porter stemmer (J4), applied the way the reference's ROUGE scorer does:
only to tokens longer than 3 characters.

Written from the published algorithm (M. F. Porter, "An algorithm for
suffix stripping", 1980) with the documented variants of the common
"NLTK extensions" mode that the scorer uses: words of length <= 2 are left
alone, a short irregular-forms table, 'ies'/'ied' on 4-letter words, the
'bli' -> 'ble', 'fulli' -> 'ful' and 'logi' -> 'log' step-2 rules, 'alli'
tried first, step 1c requiring a consonant before 'y', and a 2-letter
vowel-consonant word counting as *cvc.

Called from the scorer's Arrow UDF (``operators.metrics``) with a per-worker
memo table, so each distinct word is stemmed once per Python worker.
"""

from __future__ import annotations

from functools import lru_cache

# FIXED VALUES: irregular forms of the extension mode.
IRREGULAR = {
    "skies": "sky",
    "sky": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}

# FIXED VALUES: the suffix tables of the paper's steps 2, 3 and 4 (with the
# variants named above); of the suffixes that a word ends with, the longest counts.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def shape(word: str) -> str:
    """One letter per letter: v for a vowel, c for a consonant; y is a vowel
    after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    """The paper's m: how often a consonant follows a vowel."""
    return shape(stem).count("vc")


def short_ending(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end; of a
    two-letter word, vowel and consonant."""
    s = shape(word)
    return s == "vc" or (s.endswith("cvc") and word[-1] not in "wxy")


def longest(word: str, suffixes) -> str | None:
    """The longest of ``suffixes`` that ``word`` ends with."""
    return next((word[i:] for i in range(len(word)) if word[i:] in suffixes), None)


def plurals(w: str) -> str:  # step 1a
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def past_and_progressive(w: str) -> str:  # step 1b
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
    base = w[: len(w) - cut]
    if not cut or "v" not in shape(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) > 1 and base[-1] == base[-2] and shape(base)[-1] == "c":
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if measure(base) == 1 and short_ending(base) else base


def final_y(w: str) -> str:  # step 1c
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and shape(w[:-1])[-1] == "c" else w


def double_suffixes(w: str) -> str:  # step 2
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return double_suffixes(w[:-2])
    end = longest(w, STEP_2)
    if end is None:
        return w
    stem = w[: len(w) - len(end)]
    return stem + STEP_2[end] if measure(stem + "l" if end == "logi" else stem) > 0 else w


def adjective_suffixes(w: str) -> str:  # step 3
    end = longest(w, STEP_3)
    if end is None:
        return w
    stem = w[: len(w) - len(end)]
    return stem + STEP_3[end] if measure(stem) > 0 else w


def single_suffixes(w: str) -> str:  # step 4
    end = longest(w, STEP_4)
    if end is None:
        return w
    stem = w[: len(w) - len(end)]
    allowed = measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t")))
    return stem if allowed else w


def final_e_and_l(w: str) -> str:  # steps 5a and 5b
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not short_ending(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


STEPS = (plurals, past_and_progressive, final_y, double_suffixes, adjective_suffixes, single_suffixes, final_e_and_l)


@lru_cache(maxsize=1 << 18)
def porter_stem(word: str) -> str:
    """Stem one lower-case word."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    for step in STEPS:
        w = step(w)
    return w


def stem_tokens_py(tokens) -> list[str]:
    """Scorer rule: stem only tokens longer than 3 characters."""
    return [porter_stem(t) if len(t) > 3 else t for t in tokens]
