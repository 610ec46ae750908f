"""Quality rules: counts of a text, and a linear-chain conditional random
field over its lines.

Every line with a word gets a feature vector (shares of symbols, capitals,
digits, repeated words ...).  Viterbi decoding labels the line sequence as
content or boilerplate; a text is kept if it passes the base rules and at
least ``min_content`` of its words stand on content lines.

Only documents are labelled, so the labels of lines are latent: a line of a
good document is content, and one of a bad document boilerplate, with odds of
``EVIDENCE`` nats, and the field is fitted by gradient ascent on the likelihood
of that evidence, summed over all labellings.  So prose in a bad document may
be content, and a menu in a good one boilerplate.  Transitions stay within
``STEP_CAP``, or one long document would settle all its lines alike.  Learning
takes a bounded sample: at most about ``sample_docs`` documents, and of each the
middle ``SAMPLE_LINES`` lines.  Every line of every text is labelled.

Null and empty texts, and an empty table's none, have no words, so they fail
the base rules; without any labelled document the fixed prior weights are used.
Repeated rows are judged alike, one row each; further columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: fixed values of the base rules
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent
#: labelled documents that the field is fitted on, at most
SAMPLE_DOCS = 1200
#: lines of such a document, at most
SAMPLE_LINES = 256
#: log-odds that a line has the label of its document
EVIDENCE = 1.5
#: weights of transitions are at most this, and at least minus this
STEP_CAP = 0.5
MIN_CONTENT = 0.5
#: shares of characters are taken times this, up to 1
SHARE_SCALE = 5
#: strength of the quadratic prior on the weights
PENALTY = 1e-5
FEATURES = ("one", "symbols", "capitals", "marks", "digits", "repeated", "same_as_last", "copy", "words", "word_length")
CONTENT, BOILERPLATE = 0, 1


class Field(NamedTuple):
    """Weights of the boilerplate label (content's are 0) and transitions."""

    weight: np.ndarray
    step: np.ndarray


PRIOR = Field(np.array([-3.0, 8, 4, 4, 2, 4, 8, 4, 0, 0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def _classes() -> np.ndarray:
    """Class bits of code points: 1 blank, 2 symbol, 4 capital, 8 digit,
    16 other mark, 32 letter."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        table[c] = 4 * x.isupper() | 8 * x.isdigit() | 32 * x.isalpha() | 16 * (x in "!?;:\"'(){}[]=~^_/\\@+")
    table[0x3000:] = 32
    for x in BLANKS:
        table[ord(x)] = 1
    for x in SYMBOLS:
        table[ord(x)] |= 2
    return table


CLASSES = _classes()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Counts(NamedTuple):
    """Per text: the base counts; per line with a word: text, words, features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_doc: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def count(texts: list[str]) -> Counts:
    """All counts of a list of texts, from one array of their characters."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    # a line break after each text, so that no word or line crosses texts
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = CLASSES[flat]
    blank = (bits & 1).astype(bool)
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]  # words
    doc_end = np.cumsum(size + 1)
    word_doc = np.searchsorted(doc_end, begin, side="right")
    breaks = np.flatnonzero(flat == 10)
    word_line = np.searchsorted(breaks, begin, side="left")
    n_words = np.bincount(word_doc, minlength=n)
    length = end - begin

    def in_text(bit: int) -> np.ndarray:
        total = np.r_[0, np.cumsum((bits & bit) > 0)]
        return total[doc_end] - total[doc_end - size - 1]

    # words as 64-bit hashes: wrapping sums of position-weighted characters
    power = np.uint64(0x100000001B3) ** np.arange(int(length.max(initial=0)) + 1, dtype=np.uint64)
    inside = np.flatnonzero(~blank)
    place = inside - np.repeat(begin, length)
    parts = _mixed(flat[inside]) * power[place]
    word = np.add.reduceat(parts, np.cumsum(length) - length) if len(parts) else np.zeros(0, np.uint64)
    word = _mixed(word)

    # windows of five words that a text has twice or more
    m = max(0, len(word) - WINDOW + 1)
    whole = word_doc[:m] == word_doc[WINDOW - 1 :][:m]
    window = np.zeros(m, np.uint64)
    for i in range(WINDOW):
        window = _mixed(window * np.uint64(3) + word[i : i + m])
    window = _mixed(window + _mixed(word_doc[:m]))
    at = np.flatnonzero(whole)
    _, inv, times = np.unique(window[at], return_inverse=True, return_counts=True)
    again = at[times[inv] > 1]
    cover = np.zeros(len(word) + 1, np.int64)
    cover[again] += 1
    np.subtract.at(cover, again + WINDOW, 1)
    repeated = np.cumsum(cover)[:-1] > 0

    # lines
    line, first, line_words = np.unique(word_line, return_index=True, return_counts=True)
    line_doc = word_doc[first]
    copy = np.zeros(len(line), bool)
    dup = np.zeros(n, np.int64)
    starts = np.searchsorted(line_doc, np.arange(n + 1))
    doc_first_line = np.searchsorted(breaks, doc_end - size - 1, side="left")
    for d in np.flatnonzero(np.diff(starts) > 1):
        lines, seen = texts[d].split("\n"), set()
        for k in range(starts[d], starts[d + 1]):
            s = lines[line[k] - doc_first_line[d]]
            if s in seen:
                copy[k] = True
                dup[d] += 1
            seen.add(s)

    sums = {b: np.r_[0, np.cumsum((bits & b) > 0)] for b in (2, 4, 8, 16, 32)}
    z = breaks[line]
    a = np.where(line > 0, breaks[np.maximum(line - 1, 0)] + 1, 0)
    chars = np.add.reduceat(length, first) if len(first) else np.zeros(0, np.int64)
    share = lambda b, of: np.minimum(1, SHARE_SCALE * (sums[b][z] - sums[b][a]) / np.maximum(1, of))
    same = np.r_[False, word[1:] == word[:-1]] if len(word) else np.zeros(0, bool)
    per_line = lambda x: np.add.reduceat(x.astype(float), first) / line_words if len(first) else np.zeros(0)
    features = np.stack(
        [
            np.ones(len(line)),
            share(2, chars),
            share(4, sums[32][z] - sums[32][a]),
            share(16, chars),
            share(8, chars),
            per_line(repeated),
            per_line(same),
            copy.astype(float),
            np.log1p(line_words) / 4,
            np.minimum(chars / np.maximum(1, line_words), 40) / 10,
        ],
        axis=1,
    )
    return Counts(
        n_words,
        np.bincount(word_doc, length, n).astype(np.int64),
        in_text(2),
        dup,
        np.bincount(word_doc, repeated, n).astype(np.int64),
        line_doc,
        line_words,
        features,
    )


def _steps(line_doc: np.ndarray) -> list[np.ndarray]:
    """Indices of the first lines of all texts, of the second lines, and so
    on; texts with most lines first, so each is a prefix of the one before."""
    if not len(line_doc):
        return []
    _, start, lines = np.unique(line_doc, return_index=True, return_counts=True)
    order = np.argsort(-lines, kind="stable")
    start, lines = start[order], lines[order]
    active = np.searchsorted(-lines, -np.arange(lines[0]), side="left")
    return [start[:n] + i for i, n in enumerate(active)]


def viterbi(features: np.ndarray, line_doc: np.ndarray, field: Field) -> np.ndarray:
    """Most likely label sequence of each text's lines."""
    score = features @ field.weight
    labels = np.zeros(len(score), np.int8)
    steps = _steps(line_doc)
    if not steps:
        return labels
    best = np.stack([np.zeros(len(steps[0])), score[steps[0]]], axis=1)
    back = []
    for at in steps[1:]:
        way = best[: len(at), :, None] + field.step  # from, to
        back.append(way.argmax(axis=1))
        new = way.max(axis=1)
        new[:, 1] += score[at]
        best[: len(at)] = new  # shorter texts keep their last scores
    state = best.argmax(axis=1)
    for i in range(len(steps) - 1, -1, -1):
        n = len(steps[i])
        labels[steps[i]] = state[:n]
        if i:
            state[:n] = back[i - 1][np.arange(n), state[:n]]
    return labels


def marginals(features: np.ndarray, steps: list[np.ndarray], w: np.ndarray, t: np.ndarray, hint: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: each line's probability of boilerplate, and the
    expected number of each transition; ``hint`` is added to the scores."""
    score = features @ w if hint is None else features @ w + hint
    emit, trans = np.exp(np.clip(score, -30, 30)), np.exp(t)
    alpha, beta = np.zeros((len(score), 2)), np.ones((len(score), 2))
    for i, at in enumerate(steps):
        alpha[at] = alpha[steps[i - 1][: len(at)]] @ trans if i else 1
        alpha[at, 1] *= emit[at]
        alpha[at] /= alpha[at].sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for i in range(len(steps) - 1, 0, -1):
        at = steps[i]
        before = steps[i - 1][: len(at)]
        after = beta[at] * np.stack([np.ones(len(at)), emit[at]], axis=1)
        both = alpha[before][:, :, None] * trans * after[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[before] = after @ trans.T
        beta[before] /= beta[before].sum(axis=1, keepdims=True)
    post = alpha * beta
    return post[:, 1] / post.sum(axis=1), pairs


def train(
    features: np.ndarray, line_doc: np.ndarray, label: np.ndarray, rounds: int = 300, evidence: float | None = None, cap: float = np.inf
) -> Field:
    """Maximum conditional likelihood with a quadratic prior, by Adam.

    ``label`` holds the labels of the lines.  With ``evidence`` they are only
    log-odds for one, and the likelihood sums over all labellings; ``cap``
    bounds the transitions."""
    if not len(label) or len(np.unique(label)) < 2:
        return PRIOR
    steps = _steps(line_doc)
    n = len(label)
    w, t = np.zeros(features.shape[1]), np.zeros((2, 2))
    mean, var = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    given, pairs = label, np.zeros((2, 2))
    for a, b in zip(steps, steps[1:], strict=False):
        np.add.at(pairs, (label[a[: len(b)]], label[b]), 1)
    hint = None if evidence is None else np.where(label == BOILERPLATE, evidence, -evidence)
    for k in range(1, rounds + 1):
        if hint is not None:
            given, pairs = marginals(features, steps, w, t, hint)
        post, got = marginals(features, steps, w, t)
        grad = np.r_[features.T @ (given - post), (pairs - got).ravel()] / n - PENALTY * np.r_[w, t.ravel()]
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        move = 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.999**k)) + 1e-9)
        w, t = w + move[: len(w)], np.clip(t + move[len(w) :].reshape(2, 2), -cap, cap)
    return Field(w, t)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit on at most about ``sample_docs`` labelled documents, taken by a
    hash of the id; only the features of at most ``SAMPLE_LINES`` lines of
    each reach the driver."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = good.count()
    if not n:
        return PRIOR
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / n))
    sample = docs.select("doc_id", "text").filter(part).join(good.filter(part), "doc_id")

    def fn(texts: list[str]) -> dict:
        c = count(texts)
        cut = np.searchsorted(c.line_doc, np.arange(len(texts) + 1))
        spare = np.maximum(0, np.diff(cut) - SAMPLE_LINES)
        begin, end = cut[:-1] + spare // 2, cut[1:] - (spare - spare // 2)
        return {"lines": [c.features[a:b].ravel() for a, b in zip(begin, end, strict=True)]}

    rows = map_texts(sample, fn, "lines array<double>", ("doc_id", "quality")).orderBy("doc_id").collect()
    each = [np.array(r["lines"]).reshape(-1, len(FEATURES)) for r in rows]
    if not each:
        return PRIOR
    sizes = [len(x) for x in each]
    label = np.repeat([BOILERPLATE if r["quality"] == 0 else CONTENT for r in rows], sizes)
    return train(np.concatenate(each), np.repeat(np.arange(len(each)), sizes), label, evidence=EVIDENCE, cap=STEP_CAP)


def judge(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base counts, ``content_share`` and the verdict of every text."""

    def fn(texts: list[str]) -> dict:
        c = count(texts)
        label = viterbi(c.features, c.line_doc, field)
        content = np.bincount(c.line_doc, c.line_words * (label == CONTENT), len(texts))
        share = content / np.maximum(1, c.n_words)
        failed = (c.n_words < MIN_WORDS) | (100 * c.n_repeat_words > MAX_REPEATED * c.n_words)
        return {
            "n_words": c.n_words,
            "word_chars": c.word_chars,
            "n_symbols": c.n_symbols,
            "n_dup_lines": c.n_dup_lines,
            "n_repeat_words": c.n_repeat_words,
            "base_failed": failed,
            "kept": ~failed & (share >= min_content),
            "content_share": share,
        }

    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    return map_texts(docs, fn, counts + ", base_failed boolean, kept boolean, content_share double", keep)
