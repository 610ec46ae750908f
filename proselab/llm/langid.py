"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces.  Each language has a probability
for every piece; the probability of a word is the sum, over all ways to cut it
into pieces, of the product of its pieces' probabilities, which the forward
algorithm adds up in one pass.  A text's likelihood is the product over its
letter runs.  Piece probabilities are fitted by expectation-maximisation over
all segmentations (forward-backward), on a bounded sample of the labelled
documents (``per_lang``).

Every alphabetic piece of the vocabulary counts, in any script.  Letters that no
piece holds are pieces of their own, by blocks of 128 code points, so other
scripts tell languages apart as well.

Null texts and texts without a letter are ``und`` with score 0; so is every
text when there is no labelled document to learn from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import map_texts, pieces_of
from .vocab import kept, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: characters of the vocabulary's longest piece, start mark included
LONGEST = 16
#: words times positions that one table pass handles
CELLS = 1 << 19
#: positions after which probabilities are scaled up again
RESCALE = 8
#: labelled documents per language that are learned from, at most
PER_LANG = 300
#: languages that one model may hold; more is an error
MOST_LANGUAGES = 500
EM_ROUNDS = 2
#: added to every expected count
PRIOR = 0.05
UNKNOWN = "und"


class Steps:
    """``steps[node, class]`` is the next node or 0.  A node's row holds only
    the classes from its least to its greatest child; the rows lie end to end,
    and every place knows its node."""

    def __init__(self, parent: np.ndarray, klass: np.ndarray, child: np.ndarray, n_node: int, n_class: int):
        order = np.lexsort((klass, parent))
        parent, klass, child = parent[order], klass[order], child[order]
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        last = np.r_[first[1:], len(parent)] - 1
        span = klass[last] - klass[first] + 1
        begin = n_class + np.cumsum(span) - span  # any class may be asked of any row
        self.base = np.zeros(n_node, np.int32)
        self.base[parent[first]] = begin - klass[first]
        self.owner = np.zeros(2 * n_class + int(span.sum()), np.int32)
        self.target = np.zeros(len(self.owner), np.int32)
        at = self.base[parent] + klass
        self.owner[at], self.target[at] = parent, child

    def __getitem__(self, key):
        node, klass = key
        at = self.base[node] + klass
        return self.target[at] * (self.owner[at] == node)


class Trie(NamedTuple):
    """``step[node, class]`` is the next node; 0 is dead, 1 the root.  Every
    node stands for a piece or for the beginning of one."""

    step: Steps
    is_piece: np.ndarray
    klass: np.ndarray


@kept(2)
def trie(vocab_folder: str | None = None) -> Trie:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(VOCABULARY, vocab_folder))
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    pieces = {p for p in pieces if p.removeprefix(START).isalpha()}
    if (longest := max(map(len, pieces), default=0)) > LONGEST:
        raise ValueError(f"a piece of {VOCABULARY} has {longest} characters; LONGEST is {LONGEST}")
    letters = sorted({c for p in pieces for c in p} - {START})
    # class 0: nothing; 1: start mark; then letters; then blocks of the others
    klass = np.zeros(0x110000, np.int32)
    others = "".join(LETTERS.findall("".join(map(chr, range(len(klass))))))
    code = np.fromiter(map(ord, others), np.int64, len(others))
    klass[code] = (code >> 7) + 2 + len(letters)
    klass[ord(START)] = 1
    for i, c in enumerate(letters):
        klass[ord(c)] = i + 2
    blocks = np.unique(klass[klass >= 2 + len(letters)])  # those with a letter that no piece holds
    pieces |= {START, *letters}
    nodes: dict[str, int] = {"": 1}
    for p in sorted(pieces):
        for i in range(1, len(p) + 1):
            nodes.setdefault(p[:i], len(nodes) + 1)
    extra = len(nodes) + 1
    is_piece = np.zeros(extra + len(blocks), bool)
    is_piece[extra:] = True
    is_piece[[nodes[p] for p in pieces]] = True
    edges = np.array([(nodes[p[:-1]], klass[ord(p[-1])], node) for p, node in nodes.items() if p])
    edges = np.concatenate([edges, np.stack([np.ones_like(blocks), blocks, np.arange(extra, len(is_piece))], axis=1)])
    return Trie(Steps(*edges.T, len(is_piece), int(klass.max()) + 1), is_piece, klass)


def _tables(words: list[str], klass: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words as class matrices, longest first, in blocks of bounded size:
    (indices of the words, matrix, lengths)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(-size, kind="stable")
    a = 0
    while a < len(order):
        width = int(size[order[a]])
        take = order[a : a + max(1, CELLS // width)]
        text = START + START.join([words[i] for i in take])
        flat = klass[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        table = np.zeros((len(take), width), np.int32)
        table[np.arange(width) < size[take][:, None]] = flat
        yield take, table, size[take]
        a += len(take)


def _active(size: np.ndarray, width: int) -> np.ndarray:
    """How many of the words (longest first) reach each position."""
    return np.searchsorted(-size, -np.arange(width + 1), side="left")


def forward(table: np.ndarray, size: np.ndarray, step: Steps, p: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations, words x languages."""
    n, width = table.shape
    act = _active(size, width)  # act[i]: words with more than i letters
    ring = np.zeros((LONGEST + 1, n, p.shape[1]))
    ring[0] = 1
    logs = np.zeros((n, p.shape[1]))
    out = np.zeros((n, p.shape[1]))
    for i in range(width):
        here = ring[i % (LONGEST + 1)]
        if i and i % RESCALE == 0:  # keep away from underflow
            top = ring.max(axis=0)
            top[top <= 0] = 1
            ring /= top
            logs += np.log(top)
        node = np.ones(act[i], np.int32)
        for j in range(i, min(i + LONGEST, width)):
            m = act[j]
            node = step[node[:m], table[:m, j]]
            if not node.any():
                break
            ring[(j + 1) % (LONGEST + 1)][:m] += here[:m] * p[node]
        done = slice(act[i + 1], act[i])
        out[done] = np.log(ring[(i + 1) % (LONGEST + 1)][done]) + logs[done]
        here[:] = 0
    return out


def expected(table: np.ndarray, size: np.ndarray, weight: np.ndarray, step: Steps, p: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language (p: by node) over all
    segmentations of the weighted words, by forward-backward."""
    n, width = table.shape
    act = _active(size, width)
    spans = []
    alpha = np.zeros((width + 1, n))
    alpha[0] = 1
    scales = {}
    for i in range(width):
        if i and i % RESCALE == 0:  # keep away from underflow
            ahead = alpha[i : i + LONGEST + 1]
            top = ahead.max(axis=0)
            top[top <= 0] = 1
            ahead /= top
            scales[i] = top
        node = np.ones(act[i], np.int32)
        for j in range(i, min(i + LONGEST, width)):
            node = step[node[: act[j]], table[: act[j], j]]
            if not node.any():
                break
            spans.append((i, j + 1, node))
            alpha[j + 1][: len(node)] += alpha[i][: len(node)] * p[node]
    # beta carries the inverse of the scales passed, so that alpha * beta is
    # the weighted probability of a cut
    beta = np.zeros((width + 1, n))
    beta[size, np.arange(n)] = weight / alpha[size, np.arange(n)]
    counts = np.zeros(len(p))
    nodes, shares, held = [], [], 0
    for i, j, node in reversed(spans):
        part = p[node] * beta[j][: len(node)]
        for k in range(i + RESCALE - i % RESCALE, j + 1, RESCALE):
            if k in scales:
                part /= scales[k][: len(node)]
        beta[i][: len(node)] += part
        nodes.append(node)
        shares.append(alpha[i][: len(node)] * part)
        held += len(node)
        if held > CELLS:
            counts += np.bincount(np.concatenate(nodes), np.concatenate(shares), len(p))
            nodes, shares, held = [], [], 0
    if held:
        counts += np.bincount(np.concatenate(nodes), np.concatenate(shares), len(p))
    return counts


def _sample(train: DataFrame, counts: dict[str, int], per_lang: int) -> DataFrame:
    """At most ``per_lang`` documents of each language, by hash of the id; a
    hash threshold thins each language before any row is shuffled."""
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 2.0 * per_lang / n)])
    h = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = train.withColumn("h", h).filter(F.col("h") < F.element_at(rate, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    return thin.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_lang).select("lang", "text")


def fit(
    train: DataFrame, per_lang: int = PER_LANG, rounds: int = EM_ROUNDS, vocab_folder: str | None = None
) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (nodes x languages).

    ``train``: doc_id, text, lang.  Each round is one Spark job; the driver
    gets one row per (language, piece), bounded by the fixed vocabulary."""
    spark = train.sparkSession
    ship_package(spark)
    clean = train.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in clean.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    t = trie(vocab_folder)
    n = len(t.is_piece)
    if not counts:
        return [], np.zeros((n, 0))
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    # words of the sample, counted
    words = map_texts(
        _sample(clean, counts, per_lang), lambda ts: {"words": [LETTERS.findall(t.lower()) for t in ts]}, "words array<string>", ("lang",)
    )
    words = words.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count().persist()
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    probs = {lang: t.is_piece / t.is_piece.sum() for lang in langs}

    def e_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, sums = trie(vocab_folder), {}
        for batch in batches:
            frame = batch.to_pandas()
            for lang, g in frame.groupby("lang"):
                weight = g["count"].to_numpy(float)
                for take, table, size in _tables(g["word"].tolist(), t.klass):
                    sums[lang] = sums.get(lang, 0) + expected(table, size, weight[take], t.step, probs[lang])
        for lang, c in sums.items():
            node = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(node), "node": node.astype("i4"), "c": c[node]})

    for _ in range(rounds):
        got = words.mapInArrow(e_step, "lang string, node int, c double").groupBy("lang", "node").agg(F.sum("c").alias("c"))
        new = {lang: PRIOR * t.is_piece for lang in langs}
        for r in got.collect():
            new[r["lang"]][r["node"]] += r["c"]
        probs = {lang: c / c.sum() for lang, c in new.items()}
    words.unpersist()
    return langs, np.stack([probs[x] for x in langs], axis=1) if langs else np.zeros((n, 0))


def log_likelihoods(texts: list[str], p: np.ndarray, t: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text in each language, and its letter runs."""
    found = [LETTERS.findall(x.lower()) for x in texts]
    n_words = np.fromiter(map(len, found), np.int64, len(found))
    flat = [w for ws in found for w in ws]
    if not flat:
        return np.zeros((len(texts), p.shape[1])), n_words
    codes, words = pd.factorize(np.array(flat, dtype=object))
    per_word = np.zeros((len(words), p.shape[1]))
    for take, table, size in _tables(words.tolist(), t.klass):
        per_word[take] = forward(table, size, t.step, p)
    doc = np.repeat(np.arange(len(texts)), n_words)
    sums = [np.bincount(doc, per_word[codes, k], len(texts)) for k in range(p.shape[1])]
    return np.stack(sums, axis=1), n_words


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",), vocab_folder: str | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` (posterior under equal priors)."""
    langs, p = model
    shared = docs.sparkSession.sparkContext.broadcast(p)  # vocabulary x languages

    def fn(texts: list[str]) -> dict:
        if not langs:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)}
        ll, n_words = log_likelihoods(texts, shared.value, trie(vocab_folder))
        ll -= ll.max(axis=1, keepdims=True)
        post = np.exp(ll) / np.exp(ll).sum(axis=1, keepdims=True)
        best = post.argmax(axis=1)
        return {
            "lang_pred": [langs[b] if n else UNKNOWN for b, n in zip(best, n_words, strict=True)],
            "score": np.where(n_words > 0, post.max(axis=1), 0.0),
        }

    return map_texts(docs, fn, "lang_pred string, score double", keep)
