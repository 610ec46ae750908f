"""Near-duplicate classes: circulant MinHash, banding, exact verification.

A text's set holds its distinct word shingles.  Two permutations make all
signature coordinates: the first places a shingle on a circle of ``CIRCLE``
places, the second gives each place its rank; coordinate k is the least rank
k places further on.  One shingle's ranks for all coordinates are one slice of
the second permutation.  ``BANDS`` bands of ``ROWS`` coordinates propose
pairs; at a similarity of 0.8 all bands fail for one pair in 20 million.

Texts with equal sets form one class, so copies meet no further cost.  Classes
that share a band form a bucket.  No bucket emits all its pairs:

1. every class is verified against the head of one of its buckets, the class
   there that shares most buckets, and components are formed from the links;
2. in buckets that still hold several components, the classes outside the
   bucket's largest component are compared with the classes of other
   components by their sizes and one-bit sketches, a short one and then a long
   one, both with bounds far from the threshold; the few pairs that pass are
   verified as well.  A pair is met in its first common bucket only.

Two classes in one bucket and different components are always paired in step
2, so no link between components is lost.  Links are confirmed on the full
shingle sets of the whole texts.

Texts without words have an empty set and are linked with nothing.  Rows with
a null id get no component and are not kept.  Rows that share an id are one
document as far as links go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import trim_memory
from .common import map_texts, saved
from .graph import components
from .vocab import kept

CIRCLE = 1 << 20
COORDINATES = 256
BANDS, ROWS = 32, 4
#: coordinates of the long sketch, made for classes of unsettled buckets only
FINE = 4096
#: differing sketch bits that a pair at the threshold may show: the mean plus
#: so many standard deviations
SLACK, FINE_SLACK = 7.0, 5.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@kept(2)
def circle(coordinates: int = COORDINATES) -> np.ndarray:
    """Second permutation as windows: row p holds the ranks of the places
    p .. p + coordinates - 1 on the circle."""
    ranks = np.random.default_rng(41).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.r_[ranks, ranks[: coordinates - 1]], coordinates)


def place(shingles: np.ndarray) -> np.ndarray:
    """First permutation: an affine one on the circle."""
    return ((shingles % np.uint64(CIRCLE)) * np.uint64(0x2C9277B5) + np.uint64(0xAC564B05)) % np.uint64(CIRCLE)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], k: int) -> set[bytes]:
    """Distinct k-word shingles; a shorter text is one shingle."""
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def hashed_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    flat = table[np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)]
    size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    length = end - begin
    inside = np.flatnonzero(~blank)
    power = np.uint64(0x100000001B3) ** np.arange(int(length.max(initial=0)) + 1, dtype=np.uint64)
    parts = _mixed(flat[inside].astype(np.uint64)) * power[inside - np.repeat(begin, length)]
    word = _mixed(np.add.reduceat(parts, np.cumsum(length) - length)) if len(parts) else np.zeros(0, np.uint64)
    first = np.searchsorted(begin, np.cumsum(size + 1) - size - 1)
    out = []
    for a, b in zip(first, np.r_[first[1:], len(word)], strict=True):
        w = word[a:b]
        n = min(k, len(w))
        h = np.full(max(0, len(w) - n + 1) if n else 0, np.uint64(n))
        for i in range(n):
            h = _mixed(h * np.uint64(5) + w[i : i + len(h)])
        out.append(np.unique(h))
    return out


def signature(hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """All coordinates of a non-empty set."""
    windows, at = circle(coordinates), place(hashes)
    step = max(1, (1 << 19) // coordinates)
    best = windows[at[:step]].min(axis=0)
    for a in range(step, len(at), step):
        np.minimum(best, windows[at[a : a + step]].min(axis=0), out=best)
    return best


def sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest bit of every coordinate, 64 to a number."""
    return np.packbits((sig & 1).astype(bool)).view(np.int64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; band b takes the coordinates b, b + BANDS ..."""
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mixed(key * np.uint64(7) + sig[r * BANDS : (r + 1) * BANDS])
    return key.view(np.int64)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Per row: ``n_shingles``, ``digest`` of the set, band keys, sketch."""

    def fn(texts: list[str]) -> dict:
        out: dict[str, list] = {"n_shingles": [], "digest": [], "bands": [], "sketch": []}
        for h in hashed_sets(texts, k):
            out["n_shingles"].append(len(h))
            out["digest"].append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            sig = signature(h) if len(h) else None
            out["bands"].append([] if sig is None else band_keys(sig))
            out["sketch"].append([] if sig is None else sketch(sig))
        return out

    return map_texts(docs, fn, "n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            links = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if last is None or ta != last:
                    last, mine = ta, shingle_set(words_of(ta), k)
                other = shingle_set(words_of(tb), k)
                both = len(mine & other)
                if both and 100 * both >= percent * (len(mine) + len(other) - both):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links, strict=True) if links else ((), ()))], names=["a", "b"])
        trim_memory()

    t = texts.select(F.col("doc_id").alias("i"), "text")
    with_b = pairs.join(t.withColumnRenamed("text", "text_b"), F.col("b") == F.col("i")).drop("i")
    with_both = with_b.join(t.withColumnRenamed("text", "text_a"), F.col("a") == F.col("i")).select("a", "b", "text_a", "text_b")
    return with_both.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over
    links of at least ``percent`` per cent) and ``kept`` (first of its
    component) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = saved(describe(docs, k), "sets")
    # texts with equal sets: one class, named by its smallest id
    linked = rows.filter("doc_id is not null and n_shingles > 0")
    classes = linked.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = saved(classes, "classes")
    keys = classes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = saved(keys.join(shared, "key"), "buckets")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = saved(docs.join(ids, "doc_id", "left_semi"), "texts")

    # 1. each class against the most central head of its buckets
    score = members.groupBy("id").agg(F.sum("size").alias("score"))
    heads = members.join(score, "id").groupBy("key").agg(F.max(F.struct("score", -F.col("id"), F.col("id").alias("head"))).alias("top"))
    stars = members.join(heads, "key").filter("id <> top.head").groupBy("id").agg(F.max("top").alias("top"))
    info = classes.select("id", "n", "sketch")
    pairs = _with_info(stars.select(F.col("top.head").alias("a"), F.col("id").alias("b")), info).filter(_plausible(percent))
    links = saved(confirmed(pairs.select("a", "b"), texts, k, percent), "links")
    found = saved(components(links), "components")

    # 2. what is left outside the largest component of each bucket
    placed = members.select("band", "key", "id").join(found, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("c"))
    sizes = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("size", "c")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = saved(placed.join(open_.select("key", F.col("top.c").alias("top")), "key"), "open")
    unsettled = texts.join(placed.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    fine = map_texts(unsettled, lambda ts: {"fine": [sketch(signature(h, FINE)) for h in hashed_sets(ts, k)]}, "fine array<bigint>")
    more_info = classes.select("id", "n", "sketch", "bands").join(saved(fine, "sketches").withColumnRenamed("doc_id", "id"), "id")
    rest = placed.filter("c <> top").join(more_info, "id").select(
        F.col("id").alias("a"), "key", "band", F.col("c").alias("ca"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("bands").alias("ba"), F.col("fine").alias("fa")
    )
    others = placed.join(more_info, "id").select(
        F.col("id").alias("b"), "key", F.col("c").alias("cb"), "top", F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("bands").alias("bb"), F.col("fine").alias("fb")
    )
    # a pair comes up in its first common bucket only; of two classes outside
    # the largest component, the smaller id is paired with the larger
    once = (F.col("cb") == F.col("top")) | (F.col("a") < F.col("b"))
    for i in range(BANDS):
        once = once & ((F.col("band") <= i) | (F.col("ba")[i] != F.col("bb")[i]))
    near = _plausible(percent) & _few_differ("fa", "fb", FINE, percent, FINE_SLACK)
    more = rest.join(others, "key").filter((F.col("ca") != F.col("cb")) & once & near).select("a", "b")
    links = links.union(saved(confirmed(saved(more, "pairs"), texts, k, percent), "links"))
    found = saved(components(links), "components")

    named = classes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("c"))
    named = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(F.col("doc_id").isNotNull(), F.when(alone, F.col("doc_id")).otherwise(F.col("c")))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _with_info(pairs: DataFrame, info: DataFrame) -> DataFrame:
    return pairs.join(info.toDF("a", "na", "sa"), "a").join(info.toDF("b", "nb", "sb"), "b")


def _few_differ(one: str, other: str, bits: int, percent: int, slack: float):
    """Sketches as close as those of a pair at the threshold are."""
    share = (1 - percent / 100) / 2
    most = int(bits * share + slack * (bits * share * (1 - share)) ** 0.5)
    return sum((F.bit_count(F.col(one)[i].bitwiseXOR(F.col(other)[i])) for i in range(bits // 64)), F.lit(0)) <= most


def _plausible(percent: int):
    """Size and sketch conditions that a pair at the threshold meets."""
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return near & _few_differ("sa", "sb", COORDINATES, percent, SLACK)
