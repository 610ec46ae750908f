"""Nearest neighbours by cosine over randomly rotated one-bit codes.

Every vector is normalised, rotated by one random orthogonal matrix and kept
as its signs, packed into bytes, with one correction scalar (the inner product
of the rotated vector and its code).  A query is rotated too; its inner
products with the codes are sums of table entries, one table per code byte.
Divided by the correction scalar they estimate the cosine, with a known error
bound.  Vectors whose upper bound reaches the k-th best lower bound are
reranked exactly, in double precision, on the original vectors.

Queries meet all rows in blocks: the query set and the rows are cut into
blocks of bounded size and each pair of blocks is one task's work, which sends
on k rows per query.  Nothing is sampled; every row is indexed.

Rows with a null id, and vectors that are null, empty, zero or hold null or
non-finite components, take no part.  Repeated rows count once; of an id with
several vectors the best score counts.  Vectors of different lengths never
meet.  Of equal vectors only the k + 1 smallest ids can be answers, so only
those become candidates.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package

#: standard errors that the bounds allow for
EPSILON = 3.0
#: most rows in a block of candidates and of queries
BLOCK_ROWS = 1 << 16
BLOCK_QUERIES = 1 << 13
RESULT = "query_id long, vec_id long, score double"


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """The random orthogonal matrix of a dimension (seeded)."""
    q, r = np.linalg.qr(np.random.default_rng(977 + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of the rows of ``x``."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rotated = unit @ rotation(x.shape[1]).T
    return np.packbits(rotated >= 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(x.shape[1])


def estimates(codes: np.ndarray, fidelity: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x rows) and the rows' error bounds."""
    dim = queries.shape[1]
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    rotated = unit @ rotation(dim).T
    padded = np.zeros((len(queries), codes.shape[1] * 8))
    padded[:, :dim] = rotated
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
    tables = np.einsum("qbi,vi->qbv", padded.reshape(len(queries), -1, 8), signs)
    total = np.zeros((len(queries), len(codes)))
    for b in range(codes.shape[1]):
        total += tables[:, b][:, codes[:, b]]
    est = (2 * total - rotated.sum(axis=1, keepdims=True)) / np.sqrt(dim) / fidelity
    bound = EPSILON * np.sqrt(np.maximum(1 - fidelity**2, 0)) / fidelity / np.sqrt(max(dim - 1, 1))
    return est, bound + 1e-9


def block_top(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, codes: np.ndarray, fidelity: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of one block for each of its queries."""
    out = []
    norm_x, norm_q = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    step = max(1, (1 << 21) // max(1, len(x)))
    for a in range(0, len(q), step):
        part = slice(a, a + step)
        est, bound = estimates(codes, fidelity, q[part])
        own = query_id[part, None] == vec_id
        lower = np.where(own, -np.inf, est - bound)
        kth = np.partition(lower, -k, axis=1)[:, -k] if len(x) > k else np.full(len(lower), -np.inf)
        qi, xi = np.nonzero((est + bound >= kth[:, None]) & ~own)
        score = np.empty(len(qi))
        for b in range(0, len(qi), 1 << 17):
            s = slice(b, b + (1 << 17))
            score[s] = np.einsum("ij,ij->i", q[a + qi[s]], x[xi[s]]) / (norm_q[a + qi[s]] * norm_x[xi[s]])
        order = np.lexsort((vec_id[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = place < k
        out.append(pd.DataFrame({"query_id": query_id[a + qi[top]], "vec_id": vec_id[xi[top]], "score": score[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(v: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda c: c != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows of every
    row of ``vectors`` (vec_id, embedding) for which ``is_query`` holds."""
    ship_package(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.filter(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("embedding")), F.lit(False))).dropDuplicates(["vec_id", "embedding"])
    same = Window.partitionBy("embedding").orderBy("vec_id")
    rows = v.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy")
    rows = rows.select("vec_id", "embedding", F.size("embedding").alias("dim"))
    queries = v.filter(is_query).select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim"))
    n = v.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(is_query, 1)).alias("queries")).first()
    # enough blocks to spread, none beyond the bounds
    row_blocks = -(-n["rows"] // min(BLOCK_ROWS, max(1024, n["rows"] // 64))) or 1
    query_blocks = -(-n["queries"] // min(BLOCK_QUERIES, max(256, n["queries"] // 8))) or 1

    def codes(frames):
        for f in frames:
            for dim, g in f.groupby("dim"):
                c, fid = encode(np.stack(g["embedding"].to_numpy()))
                yield g.assign(code=[x.tobytes() for x in c], fidelity=fid)

    coded = rows.mapInPandas(codes, "vec_id long, embedding array<double>, dim int, code binary, fidelity double")
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", mine("query_id", query_blocks)).withColumn("rb", every(row_blocks))
    right = coded.withColumn("rb", mine("vec_id", row_blocks)).withColumn("qb", every(query_blocks))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        code = np.frombuffer(b"".join(r["code"]), np.uint8).reshape(len(r), -1)
        return block_top(
            q["query_id"].to_numpy(), np.stack(q["embedding"].to_numpy()), r["vec_id"].to_numpy(),
            np.stack(r["embedding"].to_numpy()), code, r["fidelity"].to_numpy(), k,
        )

    cell = ["dim", "qb", "rb"]
    best = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(meet, RESULT)
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
