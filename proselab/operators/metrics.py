"""Text-pair quality metrics.

Input is a *pairs* frame: key column(s), a hypothesis text and a reference
text.  Every metric returns ``key + score columns``.

* A pair is one row, so the text metrics (ROUGE-1/2/L, BLEU-4) are one narrow
  step: an Arrow UDF reads both texts once and returns the counts (clipped
  n-gram overlaps, lengths, LCS length); the scores are column expressions
  over the counts.  Nothing is exploded, shuffled or written.  ROUGE-L's LCS
  is bit-parallel (Allison & Dix 1986, Hyyrö 2004) on Python integers,
  O(n*m/64) word operations, no truncation.
* cosine works on given vectors with native array functions; soft match
  joins bounded vector blocks block x block within a pair and computes each
  block's similarity matrix with numpy inside the task.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow as A
from ..functions.stem import stem_tokens_py

ROUGE_TOKEN = re.compile("[a-z0-9]+")  # same tokens as: non [a-z0-9] -> space, split, drop empties
BLEU_EPSILON = 0.1  # smoothing "method 1"
BLEU_ORDERS = (1, 2, 3, 4)


# ----------------------------------------------------------------- counts --
def rouge_tokens(text: str | None, stem: bool = False) -> list[str]:
    """J1 (+J4): lower, then the ``[a-z0-9]+`` runs; optionally Porter-stem
    tokens longer than 3 characters."""
    tokens = ROUGE_TOKEN.findall((text or "").lower())
    return stem_tokens_py(tokens) if stem else tokens


def overlap(h: list[str], r: list[str], n: int) -> int:
    """Clipped number of common n-grams."""
    grams = Counter(zip(*(h[i:] for i in range(n))))
    return (grams & Counter(zip(*(r[i:] for i in range(n))))).total()


def f_measure(ov: Column, hyp_total: Column, ref_total: Column) -> Column:
    """P = ov/max(hyp,1), R = ov/max(ref,1), F = 2PR/(P+R), 0 when P+R = 0."""
    p = ov / F.greatest(hyp_total, F.lit(1))
    r = ov / F.greatest(ref_total, F.lit(1))
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


# ----------------------------------------------------------------- LCS --
#: tokens of the shorter side in one stripe of the bit table
STRIPE = 1 << 15


def lcs_length_py(a, b, stripe: int = STRIPE) -> int:
    """Bit-parallel LCS length of two token sequences.

    The bit vector stands over the shorter side and is worked through in
    stripes of ``stripe`` tokens.  All that one stripe owes the next is the
    carry of its addition at each token of the longer side, a byte a token; the
    masks are those of a single stripe.  So memory is the two sides and at most
    ``stripe`` masks of ``stripe`` bits, however long the texts are."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a
    carries = bytearray(len(a)) if len(b) > stripe else None
    found = 0
    for at in range(0, len(b), stripe):
        part = b[at : at + stripe]
        # bit masks over the positions of this stripe
        masks: dict = {}
        for i, t in enumerate(part):
            masks[t] = masks.get(t, 0) | (1 << i)
        width = len(part)
        full = (1 << width) - 1
        v, get = full, masks.get
        if carries is None:
            for t in a:
                u = v & get(t, 0)
                v = ((v + u) | (v - u)) & full
        else:
            for k, t in enumerate(a):
                m = get(t, 0)
                if m or carries[k]:
                    u = v & m
                    total = v + u + carries[k]
                    carries[k] = total >> width
                    v = (total | (v - u)) & full
        found += width - v.bit_count()
    return found


_ROUGE_COUNTS = ("hn", "rn", "ov1", "ov2", "lcs")
_BLEU_COUNTS = ("bhn", "brn", "b1", "b2", "b3", "b4")


def _pair_counts(stem: bool, rouge: bool, lcs: bool, bleu: bool):
    """UDF (hyp, ref) -> struct of the counts; both texts are read once."""
    names = (_ROUGE_COUNTS if rouge else ()) + (_BLEU_COUNTS if bleu else ())

    def one(hyp: str | None, ref: str | None) -> tuple:
        out: tuple = ()
        if rouge:
            h, r = rouge_tokens(hyp, stem), rouge_tokens(ref, stem)
            out += (len(h), len(r), overlap(h, r, 1), overlap(h, r, 2), lcs_length_py(h, r) if lcs else 0)
        if bleu:
            h, r = (hyp or "").split(), (ref or "").split()
            out += (len(h), len(r), *(overlap(h, r, n) for n in BLEU_ORDERS))
        return out

    @F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in names]))
    def counts(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        kind = pa.struct([(n, pa.int64()) for n in names])
        return A.one_by_one(kind, (dict(zip(names, one(h, r))) for h, r in zip(A.texts_of(hyp), A.texts_of(ref))))

    return counts


# -------------------------------------------------------------- scorers --
def _ratio(of: Column, total: Column) -> Column:
    return of / F.greatest(total, F.lit(1))


def _rouge_columns(c: str) -> list[Column]:
    hn, rn = F.col(f"{c}.hn"), F.col(f"{c}.rn")
    out = []
    for n in (1, 2):
        ov = F.col(f"{c}.ov{n}")
        hc, rc = F.greatest(hn - n + 1, F.lit(0)), F.greatest(rn - n + 1, F.lit(0))
        out += [_ratio(ov, hc).alias(f"rouge{n}_p"), _ratio(ov, rc).alias(f"rouge{n}_r"), f_measure(ov, hc, rc).alias(f"rouge{n}_f")]
    ok = (hn > 0) & (rn > 0)
    p = F.when(ok, F.col(f"{c}.lcs") / hn).otherwise(F.lit(0.0))
    q = F.when(ok, F.col(f"{c}.lcs") / rn).otherwise(F.lit(0.0))
    f = F.when(ok & (p + q > 0), F.lit(2.0) * p * q / (p + q)).otherwise(F.lit(0.0))
    return [*out, p.alias("rougeL_p"), q.alias("rougeL_r"), f.alias("rougeL_f")]


def _bleu_column(c: str) -> Column:
    """Uniform weights, smoothing method 1 (epsilon for orders with no
    match), brevity penalty; 0 without a common word."""
    hn, rn = F.col(f"{c}.bhn"), F.col(f"{c}.brn")
    logs = F.lit(0.0)
    for n in BLEU_ORDERS:
        denom = F.greatest(hn - n + 1, F.lit(1)).cast("double")
        ov = F.col(f"{c}.b{n}")
        logs = logs + F.lit(0.25) * F.log(F.when(ov == 0, F.lit(BLEU_EPSILON) / denom).otherwise(ov / denom))
    bp = F.when(hn > rn, F.lit(1.0)).when(hn == 0, F.lit(0.0)).otherwise(F.exp(F.lit(1.0) - rn / hn))
    return F.when(F.col(f"{c}.b1") == 0, F.lit(0.0)).otherwise(bp * F.exp(logs)).alias("bleu")


def score_pairs(
    pairs: DataFrame,
    key: list[str],
    hyp: str,
    ref: str,
    stem: bool = False,
    rouge: bool = True,
    bleu: bool = False,
    keep: list[str] | tuple[str, ...] = (),
    active: str | None = None,
    lcs: bool = True,
) -> DataFrame:
    """All requested metrics of each pair in one narrow step over the pair
    rows: no shuffle, no checkpoint.  ``keep`` columns ride along; rows whose
    ``active`` column is false are counted as two empty texts (scores 0).
    Output: key + keep + rouge1_p/r/f, rouge2_p/r/f, rougeL_p/r/f [+ bleu]."""
    h, r = F.col(hyp), F.col(ref)
    if active:
        h, r = F.when(F.col(active), h), F.when(F.col(active), r)
    x = pairs.select(*key, *keep, _pair_counts(stem, rouge, lcs, bleu)(h, r).alias("_n"))
    return x.select(*key, *keep, *(_rouge_columns("_n") if rouge else []), *([_bleu_column("_n")] if bleu else []))


def rouge_n(pairs: DataFrame, key: list[str], hyp: str, ref: str, stem: bool = False) -> DataFrame:
    """ROUGE-1 and ROUGE-2 precision / recall / F per pair."""
    out = score_pairs(pairs, key, hyp, ref, stem, lcs=False)
    return out.select(*key, *[f"rouge{n}_{k}" for n in (1, 2) for k in "prf"])


def rouge_l(pairs: DataFrame, key: list[str], hyp: str, ref: str, stem: bool = False) -> DataFrame:
    """ROUGE-L (LCS) precision / recall / F per pair (0 if either side
    has no token)."""
    return score_pairs(pairs, key, hyp, ref, stem).select(*key, "rougeL_p", "rougeL_r", "rougeL_f")


def rouge_all(pairs: DataFrame, key: list[str], hyp: str, ref: str, stem: bool = False) -> DataFrame:
    """ROUGE-1/2/L F per pair (see ``score_pairs``)."""
    return score_pairs(pairs, key, hyp, ref, stem).select(*key, "rouge1_f", "rouge2_f", "rougeL_f")


def bleu4(pairs: DataFrame, key: list[str], hyp: str, ref: str) -> DataFrame:
    """Sentence BLEU-4, uniform weights, one reference, smoothing
    method 1 (epsilon 0.1 for orders with no match), brevity penalty."""
    return score_pairs(pairs, key, hyp, ref, rouge=False, bleu=True).select(*key, "bleu")


# ------------------------------------------------------------- vectors --
def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(u: str | Column, v: str | Column) -> Column:
    """Cosine similarity in double precision; 0 when a norm is 0."""
    u = F.col(u) if isinstance(u, str) else u
    v = F.col(v) if isinstance(v, str) else v
    nu, nv = F.sqrt(_dot(u, u)), F.sqrt(_dot(v, v))
    return F.when((nu > 0) & (nv > 0), _dot(u, v) / (nu * nv)).otherwise(F.lit(0.0))


def _unit(v: Column) -> Column:
    n = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


_BEST = T.ArrayType(T.StructType([T.StructField("side", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("best", T.DoubleType())]))


@F.pandas_udf(_BEST)
def _block_best(hp: pd.Series, hv: pd.Series, rp: pd.Series, rv: pd.Series) -> pd.Series:
    """Positions and unit vectors of one hypothesis block and one reference
    block -> (side, position, best cosine against the other block) of every
    token of both.  One small matrix product per row; a missing block gives 0."""
    import numpy as np

    out = []
    for a, x, b, y in zip(hp, hv, rp, rv):
        none_a, none_b = a is None or len(a) == 0, b is None or len(b) == 0
        if none_a or none_b:
            rows = [("hyp", p, 0.0) for p in ([] if none_a else a)] + [("ref", p, 0.0) for p in ([] if none_b else b)]
        else:
            sim = np.stack([np.asarray(v, dtype=np.float64) for v in x]) @ np.stack([np.asarray(v, dtype=np.float64) for v in y]).T
            rows = [("hyp", p, m) for p, m in zip(a, sim.max(axis=1))] + [("ref", p, m) for p, m in zip(b, sim.max(axis=0))]
        out.append([{"side": s, "pos": int(p), "best": float(m)} for s, p, m in rows])
    return pd.Series(out, dtype=object)


#: blocks along one side of a cell of the grid that a pair is cut into
CELL = 8


def _cells(token_vectors: DataFrame, block: int, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(block pairs, blocks of one-sided pairs): every hypothesis block beside
    every reference block of its pair.  A pair is a grid of blocks, cut into
    cells of ``cell`` x ``cell``; blocks go to the cells of their row or column
    and meet there, so what one key brings together is bounded whatever the
    length of a pair."""
    tv = token_vectors.select("pid", "side", F.col("pos").cast("long").alias("pos"), "vec")
    blocks = (
        tv.groupBy("pid", "side", F.floor(F.col("pos") / F.lit(block)).alias("_b"))
        .agg(F.collect_list(F.struct("pos", _unit(F.col("vec")).alias("u"))).alias("_items"))
        .withColumn("_own", F.floor(F.col("_b") / F.lit(cell)))
    )
    sides = blocks.groupBy("pid").agg(*(F.collect_set(F.when(F.col("side") == s, F.col("_own"))).alias(f"_{s}") for s in ("hyp", "ref")))
    # one row a pair joins its blocks: AQE splits a pair of many blocks
    other = blocks.join(sides.withColumnRenamed("pid", "_pid"), F.col("pid") == F.col("_pid"))
    h = other.filter(F.col("side") == "hyp").select("pid", F.col("_own").alias("_i"), F.explode("_ref").alias("_j"), F.col("_items").alias("_h"))
    r = other.filter(F.col("side") == "ref").select("pid", F.explode("_hyp").alias("_i"), F.col("_own").alias("_j"), F.col("_items").alias("_r"))
    alone = other.filter((F.size("_hyp") == 0) | (F.size("_ref") == 0)).select("pid", "side", "_items")
    return h.join(r, ["pid", "_i", "_j"]), alone


def soft_match(token_vectors: DataFrame, block: int = 256) -> DataFrame:
    """J7 (re-aimed BERTScore): greedy soft matching of given token vectors.

    P = mean over hypothesis token occurrences of the best cosine against the
    pair's reference tokens, R symmetric, F = 2PR/(P+R) (no IDF, no
    rescaling).  A pair with one side only has nothing to match: its scores
    are 0, and it keeps its row.

    Input: pid, side ('hyp'/'ref'), pos (position of the occurrence within its
    side), vec.  A side is cut into blocks of ``block`` positions, dealt on
    pid, side and block, and the blocks of a pair meet in the cells of a grid
    (``_cells``), dealt on pid, row and column, so one long pair is spread over
    many tasks.  A block pair is one bounded similarity matrix with numpy
    inside the task; of its one row a token the maximum combines before the
    shuffle."""
    pairs, alone = _cells(token_vectors, block)
    met = pairs.select("pid", _block_best(F.col("_h.pos"), F.col("_h.u"), F.col("_r.pos"), F.col("_r.u")).alias("_best"))
    nothing = F.transform("_items", lambda x: F.struct(F.col("side"), x["pos"].alias("pos"), F.lit(0.0).alias("best")))
    met = met.union(alone.select("pid", nothing))
    per_block = met.select("pid", F.explode_outer("_best").alias("z")).filter(F.col("z").isNotNull())
    per_token = per_block.groupBy("pid", F.col("z.side").alias("side"), F.col("z.pos").alias("pos")).agg(F.max("z.best").alias("best"))
    p, q = (F.coalesce(F.avg(F.when(F.col("side") == s, F.col("best"))), F.lit(0.0)) for s in ("hyp", "ref"))
    pr = per_token.groupBy("pid").agg(p.alias("soft_p"), q.alias("soft_r"))
    both = F.col("soft_p") + F.col("soft_r")
    return pr.withColumn("soft_f", F.when(both > 0, 2 * F.col("soft_p") * F.col("soft_r") / both).otherwise(0.0))
