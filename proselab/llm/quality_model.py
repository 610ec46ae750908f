"""Quality classifier: random-indexing word vectors, pooled per document, and
a two-layer network with temperature-calibrated probabilities.

Random indexing: every token has a fixed sparse ternary index vector, drawn
from its hash; its word vector adds the index vectors of the tokens around it,
gathered over the learning sample.  Tokens share ``BUCKETS`` hash buckets, so
the table has one size whatever the vocabulary.  A document is the mean and
the spread of its tokens' vectors.  The network and its temperature are fitted
with numpy on the pooled vectors of a bounded, documented sample of labelled
documents (``SAMPLE_DOCS``).

Null and empty texts have no tokens: their pooled vector is zero and they are
scored like any other.  Without labels of both kinds every score is the share
of good labels (0.5 if there is none).
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_texts, pieces_of

DIMS = 48
BUCKETS = 1 << 14
NONZERO = 6
#: groups of buckets whose sums are added together
SHARES = 16
REACH = 2
#: labelled documents that are learned from, at most
SAMPLE_DOCS = 4000
HIDDEN = 32
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Model(NamedTuple):
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


@functools.lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(20240607)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    at = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO)), axis=1)
    return out


def bucket(token: str) -> int:
    """Words share a bucket across cases, but shouting has one of its own."""
    shape = "^" if len(token) > 1 and token.isupper() else ""
    return zlib.crc32((shape + token.lower()).encode("utf-8", "surrogatepass")) % BUCKETS


AGAIN = bucket("<again>")  # stands where a word repeats the last one


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens, and the number of tokens of each text."""
    found = [TOKEN.findall(t) for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.array([x for ts in found for x in ts], dtype=object)
    if not len(flat):
        return np.zeros(0, np.int64), n
    codes, unique = pd.factorize(flat)
    b = np.fromiter(map(bucket, unique), np.int64, len(unique))[codes]
    word = np.fromiter((u[0].isalpha() for u in unique), bool, len(unique))[codes]
    # a word like the one before it, with or without a mark between
    doc = np.repeat(np.arange(len(texts)), n)
    again = np.zeros(len(b), bool)
    for gap in (1, 2):
        again[gap:] |= (codes[gap:] == codes[:-gap]) & word[gap:] & (doc[gap:] == doc[:-gap])
    return np.where(again, AGAIN, b), n


def pooled(b: np.ndarray, n: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each text's token vectors."""
    out = np.zeros((len(n), 2 * DIMS), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        v = vectors[b]
        start = (np.cumsum(n) - n)[full]
        mean = np.add.reduceat(v, start) / n[full, None]
        square = np.add.reduceat(v * v, start) / n[full, None]
        out[full, :DIMS] = mean
        out[full, DIMS:] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


def context_sums(b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the index vectors around each token, by bucket."""
    out = np.zeros((BUCKETS, DIMS), np.float32)
    doc = np.repeat(np.arange(len(n)), n)
    index = index_vectors()
    for gap in range(1, REACH + 1):
        near = doc[gap:] == doc[:-gap]
        left, right = b[:-gap][near], b[gap:][near]
        np.add.at(out, left, index[right])
        np.add.at(out, right, index[left])
    return out


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, rounds: int = 400, seed: int = 7) -> Model:
    """Adam on the cross entropy; a fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = ((x - mean) / scale).astype(np.float64)
    calib = np.arange(len(y)) % 5 == 0
    zt, yt = z[~calib], y[~calib]
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for k in range(1, rounds + 1):
        h = np.tanh(zt @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt) / len(yt)
        dh = np.outer(err, p[2]) * (1 - h * h)
        grads = [zt.T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ err + 1e-4 * p[2], err.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    logit = np.tanh(z[calib] @ p[0] + p[1]) @ p[2] + p[3]
    temps = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, np.where(y[calib] > 0, -1, 1) * logit / t).mean() for t in temps]
    return Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), float(temps[int(np.argmin(loss))]))


def score_pooled(x: np.ndarray, model: Model) -> np.ndarray:
    logit = np.tanh(((x - model.mean) / model.scale) @ model.w1 + model.b1) @ model.w2 + model.b2
    return 1 / (1 + np.exp(-np.clip(logit / model.temperature, -500, 500)))


def _bucket_sums(sample: DataFrame) -> DataFrame:
    """(bucket, sums): the context sums of every bucket that has any."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMS), np.float32)
        for batch in batches:
            for piece in pieces_of(batch):
                total += context_sums(*tokens([t or "" for t in piece.column("text").to_pylist()]))
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[b].tobytes() for b in some], pa.binary())], names=["bucket", "sums"])

    def add(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket").to_numpy()
        total = np.zeros((BUCKETS, DIMS), np.float32)
        np.add.at(total, bucket, np.frombuffer(b"".join(table.column("sums").to_pylist()), np.float32).reshape(-1, DIMS))
        some = np.unique(bucket)
        return pa.table({"bucket": pa.array(some, pa.int32()), "sums": pa.array([total[b].tobytes() for b in some], pa.binary())})

    rows = sample.select("text").mapInArrow(per_task, "bucket int, sums binary")
    return rows.groupBy(F.col("bucket") % SHARES).applyInArrow(add, "bucket int, sums binary")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most about ``sample_docs`` labelled documents, taken by a
    hash of the id.  Two jobs over the sample: its context sums, added up by
    bucket in Spark, so that at most ``BUCKETS`` rows reach the driver however
    many tasks there are, then its pooled vectors."""
    ship_package(docs.sparkSession)
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = good.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(n, 1)))
    sample = docs.select("doc_id", "text").filter(part).join(good.filter(part), "doc_id").repartition(4, "doc_id").persist()

    total = np.zeros((BUCKETS, DIMS), np.float32)
    for r in _bucket_sums(sample).collect():
        total[r["bucket"]] = np.frombuffer(r["sums"], np.float32)
    vectors = index_vectors() + total / np.maximum(1, np.linalg.norm(total, axis=1, keepdims=True))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)

    def fn(texts: list[str]) -> dict:
        return {"x": list(pooled(*tokens(texts), vectors))}

    rows = map_texts(sample, fn, "x array<float>", ("doc_id", "quality")).orderBy("doc_id").collect()
    sample.unpersist()
    y = np.array([float(r["quality"] > 0) for r in rows])
    if len(y) < 10 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        zero = np.zeros(2 * DIMS)
        return Model(vectors, zero, zero + 1, np.zeros((2 * DIMS, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    return train(np.array([r["x"] for r in rows]), y, vectors)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``score`` (probability of a good label) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIMS floats

    def fn(texts: list[str]) -> dict:
        s = score_pooled(pooled(*tokens(texts), shared.value.vectors), shared.value)
        return {"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return map_texts(docs, fn, "score double, predicted int", keep)
