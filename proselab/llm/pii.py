"""Personal data: fixed detectors, and detectors on deobfuscated text whose
spans are mapped back to the source characters.

Deobfuscation is a chain of transducers.  Each rewrites parts of the text and
carries, for every character it puts out, the source span it came from:

1. homoglyphs: full-width and mathematical letters and digits, Cyrillic and
   Greek look-alikes, other decimal digits; invisible characters vanish;
2. disguised addresses: ``[at]``, ``[@]``, ``(dot)``, ``[.]`` and the like, and
   `` at `` or a spaced ``@`` when a disguised dot follows; disguised dots
   before the at as well; then the same with the Spanish, French and German
   words, whose spaced dots count only next to one of their at words;
3. dotted numbers: four groups of digits with a disguised dot between any two;
4. spelled digits, in English, German, French and Spanish, ``double`` and
   ``triple`` included: runs of at least eight digits or four dotted groups.

The same detectors then run on the rewritten text.  A span is added when the
rewriting touched it and no span found in the plain text contains it; the
plain ones stay, so a span and its undisguised part may both be reported.

Spans are ``kind:start:end`` in code points, end exclusive, sorted by kind
(email, ip, card, phone) and start.  A null or empty text has none, an empty
table gives no rows, repeated rows are searched alike, one row each.  Further
columns are not read.  A text of any length is searched whole; every pattern
is linear in it, and the source map takes 16 bytes a character while it is
rewritten.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# an address is found from its @: the local part is the run before it, so no
# run is read twice; digits never begin inside a run of digits
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> list[Span]:
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL_CHARS:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at)):
            out.append((a, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGITS.sub("", m.group())) <= 15]


DIGIT = re.compile("[0-9]")


def detect(text: str) -> dict[str, list[Span]]:
    """The fixed detectors; each leftmost, without overlaps within a kind."""
    digits = DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


class Mapped(NamedTuple):
    """A rewritten text; ``start``/``end`` give each character's source span."""

    text: str
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Mapped:
        at = np.arange(len(text))
        return cls(text, at, at + 1)

    def rewrite(self, matches: list[tuple[int, int, str]]) -> Mapped:
        """Replace spans; each new character maps to the whole span."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in matches:
            text += (self.text[at:a], new)
            starts += (self.start[at:a], np.full(len(new), self.start[a]))
            ends += (self.end[at:a], np.full(len(new), self.end[b - 1]))
            at = b
        starts, ends = [*starts, self.start[at:]], [*ends, self.end[at:]]
        return Mapped("".join([*text, self.text[at:]]), np.concatenate(starts), np.concatenate(ends))


#: fixed values: letters of other scripts that look like the Latin ones below
LOOK_ALIKE = "АВЕКМНОРСТХаеорсухіјѕԁԛԝһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορν" + "․。｡"
LOOKS_LIKE = "ABEKMHOPCTXaeopcyxijsdqwh" + "ABEZHIKMNOPTYXopv" + "..."
HOMOGLYPH = dict(zip(LOOK_ALIKE, LOOKS_LIKE, strict=True))
STRANGE = re.compile("[\xadͰ-֏٠-٩۰-۹०-९​-‏․⁠。﻿！-｡\U0001d400-\U0001d7ff]")


def plain_letter(c: str) -> str:
    """What a strange character stands for; "" if it is invisible."""
    if c in HOMOGLYPH:
        return HOMOGLYPH[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if unicodedata.decimal(c, None) is not None:
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


def homoglyphs(m: Mapped) -> list[tuple[int, int, str]]:
    return [(x.start(), x.end(), new) for x in STRANGE.finditer(m.text) if (new := plain_letter(x.group())) != x.group()]


#: fixed values: words for the signs; French dots are common words of prose
AT_WORDS, DOT_WORDS = ("arroba", "arobase", "klammeraffe"), ("dot", "point", "punkt", "punto")
_ATS, _DOTS = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_IN_BRACKETS = rf"{_OPEN}(?:{_DOTS}|\.){_CLOSE}"
#: characters of the longest disguised dot
DOT_CHARS = 14 + max(map(len, DOT_WORDS))
BRACKET = re.compile(r"[\[({<]")


class Disguise(NamedTuple):
    """Patterns of a disguised address: the at with the host after it, and a
    disguised dot, anywhere and at the end."""

    hidden: re.Pattern
    dot: re.Pattern
    dot_before: re.Pattern

    @classmethod
    def of(cls, at: str, dot_words: str) -> Disguise:
        dot = rf"(?:{_IN_BRACKETS}|\s{{1,3}}(?:{dot_words})\s{{1,3}})"
        host = rf"(?P<host>[a-z0-9-]+(?:(?:{dot}|\.)[a-z0-9-]+)+)"
        return cls(*(re.compile(f"(?i){x}") for x in (rf"(?P<at>{at}){host}", dot, rf"{dot}\Z")))


ENGLISH = Disguise.of(rf"{_OPEN}(?:at|@){_CLOSE}|\s{{1,3}}at\s{{1,3}}|\s{{0,3}}@\s{{0,3}}", "dot")
OTHERS = Disguise.of(rf"{_OPEN}(?:{_ATS}){_CLOSE}|\s{{1,3}}(?:{_ATS})\s{{1,3}}", _DOTS)
HIDDEN_HINT = re.compile(rf"[\[({{<]\s{{0,3}}(?:at|@|\.|{_DOTS})\s{{0,3}}[\])}}>]|\sdot\s")
OTHERS_HINT = re.compile(_ATS)


def dots_before(text: str, at: int, floor: int, dot_before: re.Pattern) -> list[tuple[int, int]]:
    """Disguised dots in the local part that ends at ``at``, in order; what
    lies before ``floor`` belongs to another address."""
    out: list[tuple[int, int]] = []
    while True:
        while at > floor and text[at - 1] in LOCAL_CHARS:
            at -= 1
        begin = max(floor, at - DOT_CHARS)
        d = dot_before.search(text[begin:at])
        a = begin + d.start() if d else 0
        if not d or a <= floor or text[a - 1] not in LOCAL_CHARS:
            return out[::-1]
        out.append((a, at))
        at = a


def addresses(m: Mapped, how: Disguise = ENGLISH) -> list[tuple[int, int, str]]:
    out, floor = [], 0
    for x in how.hidden.finditer(m.text):
        at, dots = x["at"], [d.span() for d in how.dot.finditer(m.text, *x.span("host"))]
        before = m.text[x.start() - 1 : x.start()]
        if not (before and before in LOCAL_CHARS):
            continue
        local = dots_before(m.text, x.start(), floor, how.dot_before)
        if how is ENGLISH and not dots and not BRACKET.search(at) and not (local if at == "@" else any(BRACKET.search(m.text, *d) for d in local)):
            continue  # a plain address, or the word "at" in prose
        out += [(*d, ".") for d in local]
        if at != "@":
            out.append((*x.span("at"), "@"))
        out += [(*d, ".") for d in dots]
        floor = x.end()
    return out


def other_addresses(m: Mapped) -> list[tuple[int, int, str]]:
    return addresses(m, OTHERS)


_ANY_DOT = rf"(?:{_IN_BRACKETS}|\s{{1,3}}(?:{_DOTS})\s{{1,3}})"
DOTTED = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:(?:{_ANY_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])")
DOTTED_HINT = re.compile(rf"(?:{_DOTS}|\.)(?:\s{{0,3}}[\])}}>]\s{{0,3}}|(?<!\.)\s{{1,3}})[0-9]")
ANY_DOT = re.compile(rf"(?i){_ANY_DOT}")


def dotted(m: Mapped) -> list[tuple[int, int, str]]:
    return [(*d.span(), ".") for x in DOTTED.finditer(m.text) for d in ANY_DOT.finditer(m.text, *x.span())]


#: fixed values: number words by language, from zero
DIGIT_WORDS = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
#: fixed values: other spellings, signs, and words that repeat the next digit
OTHER_WORDS = {"oh": "0", "zwo": "2", "plus": "+", "más": "+", "mas": "+"} | dict.fromkeys(DOT_WORDS, ".")
TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3}
WORD_VALUE = OTHER_WORDS | {w: str(i) for words in DIGIT_WORDS for i, w in enumerate(words)}
_WORD = "(?:" + "|".join(w for w, v in WORD_VALUE.items() if v.isdigit()) + ")"
_UNIT = rf"(?:(?:{'|'.join(TIMES)})[\s-]{{1,2}})?(?:{_WORD}|[0-9]{{1,4}})(?!\w)"
SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:plus|m[aá]s)[\s-]{{1,2}}|\+\s?)?{_UNIT}(?:[\s,.-]{{1,2}}(?:{_UNIT}|(?:{_DOTS})(?!\w)))+")
SPELLED_HINT = re.compile(rf"{_WORD}[\s,.-]{{1,2}}(?:{_UNIT}|{_DOTS})")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[+.]")


def spelled(m: Mapped) -> list[tuple[int, int, str]]:
    out = []
    for x in SPELLED.finditer(m.text):
        words, digits, dots, times, begin = [], 0, 0, 1, -1
        for t in TOKEN.finditer(x.group()):
            w = t.group().lower()
            begin = x.start() + t.start() if begin < 0 else begin
            if w in TIMES:
                times = TIMES[w]
                continue
            new = WORD_VALUE.get(w, w)
            new = new[0] * (times - 1) + new
            digits += new.isdigit() * len(new)
            dots += new == "."
            words.append((begin, x.start() + t.end(), new))
            times, begin = 1, -1
        if digits < 8 and dots < 3:
            continue
        # one rewrite for each word and the separators after it
        for (a, _, new), (b, _, _) in zip(words, [*words[1:], (x.end(), 0, "")], strict=True):
            out.append((a, b, new))
    return out


#: hints are looked for in lower-cased text, without flags, so that a search
#: skips to the letters that they can begin with
STEPS: tuple[tuple[re.Pattern, Callable[[Mapped], list]], ...] = (
    (STRANGE, homoglyphs),
    (HIDDEN_HINT, addresses),
    (OTHERS_HINT, other_addresses),
    (DOTTED_HINT, dotted),
    (SPELLED_HINT, spelled),
)


def deobfuscate(text: str) -> Mapped | None:
    """The rewritten text, or None if no transducer finds anything."""
    m, low = None, text.lower()
    for hint, step in STEPS:
        if hint.search(low):
            here = m or Mapped.of(text)
            if found := step(here):
                m = here.rewrite(found)
                low = m.text.lower()
    return m


#: one number word of the prose after or before a whole plain span
NEXT_WORD, WORD_BEFORE = re.compile(r"[,.;]\s[^\W\d_]+"), re.compile(r"[^\W\d_]+[,.;]\s")
NEXT_TO_IP, BEFORE_IP = re.compile(r"[,.;]?\s[^\W\d_]+"), re.compile(r"[^\W\d_]+[,.;]?\s")


def is_prose(kind: str, before: str, after: str) -> bool:
    """What a span has beyond a plain one is punctuation or the next word."""
    if not any(map(str.isalnum, before + after)):
        return True
    if kind == "email":
        return False
    before, after = before.lstrip(), after.rstrip()
    next_word, word_before = (NEXT_TO_IP, BEFORE_IP) if kind == "ip" else (NEXT_WORD, WORD_BEFORE)
    return bool((not before or word_before.fullmatch(before)) and (not after or next_word.fullmatch(after)))


def hidden_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only show in the deobfuscated text, as source spans."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if (m := deobfuscate(text)) is None:
        return out
    taken = sorted(s for spans in base.values() for s in spans)
    begins, reach = [x for x, _ in taken], list(itertools.accumulate((y for _, y in taken), max))
    for kind, spans in detect(m.text).items():
        plain = base[kind]
        for a, b in spans:
            s = (int(m.start[a]), int(m.end[b - 1]))
            i = bisect_right(begins, s[0])
            if text[s[0] : s[1]] == m.text[a:b] or i and reach[i - 1] >= s[1]:
                continue  # a plain span, or inside one
            i = bisect_left(plain, s)
            inside = [p for p in plain[max(0, i - 1) : i + 1] if s[0] <= p[0] and p[1] <= s[1]]
            if not any(is_prose(kind, text[s[0] : x], text[y : s[1]]) for x, y in inside):
                out[kind].append(s)
    return out


def spans_text(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(found[k]))


def find_all(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Spans of the fixed detectors, and all spans."""
    base = detect(text)
    more = hidden_spans(text, base)
    return base, {k: base[k] + more[k] for k in KINDS}


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and digest of the fixed detectors' spans, and all spans."""

    def fn(texts: list[str]) -> dict:
        both = [find_all(t) for t in texts]
        out = {f"n_{k}": [len(b[k]) for b, _ in both] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(spans_text(b).encode()).hexdigest() for b, _ in both]
        out["spans"] = [spans_text(a) for _, a in both]
        return out

    return map_texts(docs, fn, ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string", keep)


def mask_text(text: str) -> str:
    """The text with every span replaced by ``<KIND>``; where spans of two
    kinds overlap, their union takes the kind that begins first."""
    spans = sorted((a, b, k) for k, found in find_all(text)[1].items() for a, b in found)
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        while i < len(spans) and spans[i][0] < b:
            b, i = max(b, spans[i][1]), i + 1
        out += (text[at:a], f"<{kind.upper()}>")
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` masked, all other columns as they are, whatever
    their names; a null text stays null."""
    from pyspark.sql import functions as F

    others = [c for c in docs.columns if c != "text"]
    aside = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("others")] if others else []
    packed = docs.select("text", F.struct(F.col("text").isNull().alias("none"), *aside).alias("aside"))
    out = map_texts(packed, lambda ts: {"masked": [mask_text(t) for t in ts]}, "masked string", ("aside",))
    aside = F.col("aside")
    text = F.when(~aside["none"], F.col("masked")).alias("text")
    return out.select(*(text if c == "text" else aside["others"][c].alias(c) for c in docs.columns))
