"""Toxicity by maximum-scoring segments.

Every word has a log-odds of standing in a toxic document: the logit of its
posterior toxic share less that of all words.  The prior of a word is a
Dirichlet centred on the share of its stem (first ``STEMS`` letters, longest
known first), whose own prior is centred on the next shorter stem and at last
on the share of all words; so a rare word leans on its family, and a family of
no evidence on the average.  A word counts once a document.

A text is then a sequence of scores, word log-odds less ``DRIFT``, floored at
``-DRIFT`` and negative on the average.  One linear scan finds all its maximal
scoring segments.  Extreme-value theory turns them into probabilities: lambda
solves E[exp(lambda s)] = 1 over the words of clean documents, K is the
maximum-likelihood location of the best scores of clean documents, and a
segment of score s in n words is expected K n exp(-lambda s) times by chance;
it is a passage if that is at most ``SIGNIFICANT``.  The sum statistic of a
document's best segments is one number, which a logistic curve calibrates.

Learning uses at most about ``SAMPLE_DOCS`` labelled documents, taken by a hash
of the id (four fifths for the counts, the rest for calibration) and a table
of at most ``NODES`` words and stems with evidence of toxicity.  Scoring covers
all words of all texts.

Defined cases: null, empty and wordless texts hold no passage and get the
curve's lowest score; without labels of both kinds every score is the share of
toxic labels (0 if there are none); null ids are scored like others, repeated
rows alike; an empty table gives an empty table; further columns are not read.
Texts are scanned whole, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_texts, pieces_of

#: labelled documents that are learned from, at most
SAMPLE_DOCS = 16_000
#: words and stems with evidence of toxicity that a model holds, at most
NODES = 200_000
STEMS = (4, 6, 8)
#: weight of the prior of a word and of a stem, in documents
WORD_PRIOR, STEM_PRIOR = 4.0, 10.0
DRIFT = 2.0
#: a passage is expected at most this often by chance
SIGNIFICANT = 0.05
THRESHOLD = 0.3
#: one document in five calibrates
FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")
#: words remembered by a worker, and their longest length
MEMO_WORDS, MEMO_LENGTH = 300_000, 40
#: bins a unit of score when lambda is solved for
BINS = 50


class Model(NamedTuple):
    nodes: dict[str, tuple[int, int]]  # word, or stem with a star -> documents that are toxic, clean
    share: float  # toxic share of all words
    lam: float
    k: float
    slope: float
    bias: float
    constant: float | None = None  # score of every text when there was nothing to learn


def stems(word: str) -> list[str]:
    """The stems of a word, shortest first."""
    return [word[:n] + "*" for n in STEMS if len(word) > n]


class Scores(dict):
    """word -> score, floored at -DRIFT."""

    def __init__(self, model: Model):
        super().__init__()
        self.nodes, self.share = model.nodes, model.share
        self.base = math.log(model.share / (1 - model.share)) if 0 < model.share < 1 else 0.0

    def __missing__(self, word: str) -> float:
        p = self.share
        for node in (*stems(word), word):
            if (seen := self.nodes.get(node)) is not None:
                weight = STEM_PRIOR if node.endswith("*") else WORD_PRIOR
                p = (seen[0] + weight * p) / (seen[0] + seen[1] + weight)
        out = max(0.0, math.log(p / (1 - p)) - self.base) - DRIFT if 0 < p < 1 else -DRIFT
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = out
        return out


def words(text: str) -> Iterable[str]:
    """Lower-cased words; a long text is never held as a list."""
    if len(text) < 1 << 20:
        return map(str.lower, WORD.findall(text))
    return (m.group().lower() for m in WORD.finditer(text))


def hits(text: str, scores: Scores) -> tuple[int, list[tuple[int, float]]]:
    """Number of words, and (place, score) of those that score; a word scores
    once a text."""
    found, seen, n = [], set(), 0
    get = scores.__getitem__
    for n, w in enumerate(words(text), 1):  # noqa: B007
        s = get(w)
        if s > 0 and w not in seen:
            seen.add(w)
            found.append((n - 1, s))
    return n, found


def segments(found: list[tuple[int, float]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, last word) in one
    linear scan; words between the hits cost DRIFT each."""
    out: list[list] = []  # sums before and after, first and last word
    total = 0.0
    for k, (at, s) in enumerate(found):
        before = total - DRIFT * (at - k)
        total += s
        new = [before, before + s, at, at]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= new[0]:
                j -= 1
            if j < 0 or out[j][1] >= new[1]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(b - a, i, j) for a, b, i, j in out]


def evidence(n: int, scores: list[float], lam: float, k: float) -> float:
    """Minus the log of the sum statistic's probability: the best of the r
    highest segments taken together."""
    best = total = 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        y = lam * s - math.log(k * n)
        if y <= 0:
            break
        total += y
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def solve_lambda(score: np.ndarray, count: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1, at most 1 (the root for true
    log-odds), which also stands for scores that are never positive."""
    p = count / max(count.sum(), 1)

    def f(x: float) -> float:
        return float((p * np.exp(x * score)).sum()) - 1

    if not len(score) or f(1.0) <= 0:
        return 1.0
    low, high = 1e-3, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (never negative) and bias, by Newton's method."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    if w[0] < 0:
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        return 0.0, math.log(share / (1 - share))
    return float(w[0]), float(w[1])


def _counts(sample: DataFrame) -> DataFrame:
    """node, its parent, and the documents of each kind that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, counter in enumerate(seen):
                for node, k in counter.items():
                    word = node.rstrip("*")
                    up = stems(word)
                    parent = up[-1] if up else ""
                    out.append((node, parent, k * kind, k * (1 - kind)))
                counter.clear()
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["node", "parent", "t", "c"])
            out.clear()

        out: list[tuple] = []
        for batch in batches:
            for part in pieces_of(batch):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    counter = seen[int(toxic > 0)]
                    for w in set(words(text or "")):
                        counter[w] += 1
                        counter.update(stems(w))
                if sum(map(len, seen)) > MEMO_WORDS:  # partial sums go on, Spark adds them up
                    yield from rows()
        yield from rows()

    parts = sample.select("text", "toxic").mapInArrow(run, "node string, parent string, t bigint, c bigint")
    return parts.groupBy("node", "parent").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _learn_words(sample: DataFrame, most: int) -> tuple[dict, float]:
    """Nodes with evidence of toxicity, the children that correct them, and
    the toxic share of all words; at most ``most`` rows reach the driver."""
    nodes = _counts(sample).persist()
    whole = nodes.filter(~F.col("node").endswith("*")).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    t, c = whole["t"] or 0, whole["c"] or 0
    share = t / (t + c) if t + c else 0.0
    of = F.col("t") / (F.col("t") + F.col("c"))
    raised = nodes.filter((F.col("t") >= 2) & (of > share))
    under = nodes.join(raised.filter(F.col("node").endswith("*")).select(F.col("node").alias("parent")), "parent", "left_semi")
    kept = raised.unionByName(under).distinct().orderBy(F.desc("t"), F.desc("c"), "node").limit(most)
    table = {r["node"]: (r["t"], r["c"]) for r in kept.select("node", "t", "c").collect()}
    nodes.unpersist()
    return table, share


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, nodes: int = NODES) -> Model:
    """Three jobs over the sample: word counts, the score statistics of clean
    documents, the evidence of the calibrating ones.  What reaches the driver
    is bounded by ``nodes``, the number of score bins and ``sample_docs``."""
    ship_package(docs.sparkSession)
    told = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = told.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(count, 1)))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(FOLDS))
    sample = docs.select("doc_id", "text").filter(part).join(told.filter(part), "doc_id").withColumn("fold", fold).persist()
    sizes = {(r["calibrates"], r["kind"]): r["n"] for r in sample.groupBy((F.col("fold") == 0).alias("calibrates"), (F.col("toxic") > 0).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, total = sum(n for (_, kind), n in sizes.items() if kind), sum(sizes.values())
    if not toxic or toxic == total:
        sample.unpersist()
        return Model({}, 0.0, 1.0, 1.0, 0.0, 0.0, toxic / total if total else 0.0)
    split = len(sizes) == 4  # both kinds on both sides
    table, share = _learn_words(sample.filter("fold <> 0") if split else sample, nodes)
    calibrate = sample.filter("fold = 0") if split else sample
    model = Model(table, share, 1.0, 1.0, 0.0, 0.0)
    lam, k = _extremes(calibrate.filter("toxic <= 0"), model)
    model = model._replace(lam=lam, k=k)
    rows = _evidence(calibrate, model).select("toxic", "evidence").collect()
    sample.unpersist()
    x = np.log1p([r["evidence"] for r in rows])
    slope, bias = logistic(x, np.array([float(r["toxic"] > 0) for r in rows]))
    return model._replace(slope=slope, bias=bias)


def _extremes(clean: DataFrame, model: Model) -> tuple[float, float]:
    """lambda from the histogram of word scores, then K: the number of
    documents over the sum of n exp(-lambda best), which is the likelihood's
    maximum for a Gumbel law of known scale."""
    shared = clean.sparkSession.sparkContext.broadcast(model)  # NODES rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, bins, best = Scores(shared.value), Counter(), Counter()
        for batch in batches:
            for part in pieces_of(batch):
                for text in part.column("text").to_pylist():
                    n, found = hits(text or "", scores)
                    bins[round(-DRIFT * BINS)] += n - len(found)
                    bins.update(round(s * BINS) for _, s in found)
                    if n:
                        best[round(max((s for s, _, _ in segments(found)), default=0.0) * BINS)] += n
                        best[None] += 1
        rows = [("word", b, c) for b, c in bins.items()] + [("doc" if b is None else "best", b, c) for b, c in best.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "bin", "n"])

    found = clean.select("text").mapInArrow(run, "kind string, bin bigint, n bigint").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect()
    of = {kind: np.array([(r["bin"] or 0, r["n"]) for r in found if r["kind"] == kind], float).reshape(-1, 2) for kind in ("word", "best", "doc")}
    lam = solve_lambda(of["word"][:, 0] / BINS, of["word"][:, 1])
    expected = float((of["best"][:, 1] * np.exp(-lam * of["best"][:, 0] / BINS)).sum())
    return lam, max(float(of["doc"][:, 1].sum()), 1.0) / max(expected, 1.0)


def _evidence(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memo: list[Scores] = []

    def fn(texts: list[str]) -> dict:
        if not memo:
            memo.append(Scores(shared.value))
        out = []
        for text in texts:
            n, found = hits(text, memo[0])
            out.append(evidence(n, [s for s, _, _ in segments(found)], model.lam, model.k))
        return {"evidence": out}

    model = model._replace(nodes={})
    return map_texts(docs, fn, "evidence double", ("toxic",))


def judge(text: str, model: Model, scores: Scores) -> tuple[float, list[dict]]:
    """Score of a text and its passages: code points, score, and how often a
    clean text of its length would hold one by chance."""
    n, found = hits(text, scores)
    segs = segments(found)
    x = math.log1p(evidence(n, [s for s, _, _ in segs], model.lam, model.k))
    score = 1 / (1 + math.exp(-max(-700.0, min(700.0, model.slope * x + model.bias))))
    chance = [(s, i, j, model.k * n * math.exp(-model.lam * s)) for s, i, j in segs]
    kept = [c for c in chance if c[3] <= SIGNIFICANT]
    if not kept:
        return score, []
    wanted = {p for _, i, j, _ in kept for p in (i, j)}
    at = {p: m.span() for p, m in enumerate(WORD.finditer(text)) if p in wanted}
    return score, [{"start": at[i][0], "end": at[j][1], "score": s, "expected": e} for s, i, j, e in kept]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``score``, ``predicted``, ``n_passages`` and ``passages`` (code points,
    end exclusive) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # NODES rows at most
    memo: list[Scores] = []

    def fn(texts: list[str]) -> dict:
        m = shared.value
        if not memo:
            memo.append(Scores(m))
        found = [(m.constant, []) if m.constant is not None else judge(t, m, memo[0]) for t in texts]
        return {
            "score": [s for s, _ in found],
            "predicted": [int(s >= THRESHOLD) for s, _ in found],
            "n_passages": [len(p) for _, p in found],
            "passages": [p for _, p in found],
        }

    span = "array<struct<start: bigint, end: bigint, score: double, expected: double>>"
    return map_texts(docs, fn, f"score double, predicted int, n_passages int, passages {span}", keep)
