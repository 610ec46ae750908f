"""Byte-level BPE encoding and decoding over a rank file.

Encoding a piece: a segment tree over its byte positions holds, at each leaf,
the rank of the pair that starts there; the root is the leftmost pair of
minimum rank.  A merge changes three leaves (the pair, the part it swallowed
and its live left neighbour), each a logarithmic point update.  Short pieces
are merged many at a time as rows of one matrix, long ones alone.

Null texts are empty: no ids, empty bytes.  Ids, nulls included, pass through.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .vocab import PLAIN, SPACED, SegmentCache, vocabulary_path

#: longest piece in bytes that is merged as a matrix row
ROW_BYTES = 64
#: rows merged at a time
ROWS = 20_000
NONE = np.iinfo(np.int64).max


class Ranks(NamedTuple):
    by_bytes: dict[bytes, int]
    by_id: list[bytes]
    byte_id: np.ndarray
    #: sorted ``left id << 32 | right id`` of all pairs that merge, and their ranks
    pair: np.ndarray
    rank: np.ndarray
    by_pair: dict[int, int]


@functools.lru_cache(maxsize=2)
def load(name: str, folder: str | None = None) -> Ranks:
    with open(vocabulary_path(name, folder), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    by_id = [b""] * (max(ranks.values()) + 1)
    pairs = {}
    for token, rank in ranks.items():
        by_id[rank] = token
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = rank
    pair = np.array(sorted(pairs), np.int64)
    rank = np.array([pairs[p] for p in pair.tolist()], np.int64)
    byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return Ranks(ranks, by_id, byte_id, pair, rank, pairs)


def _pair_ranks(r: Ranks, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left << 32 | right
    at = np.minimum(np.searchsorted(r.pair, key), len(r.pair) - 1)
    return np.where(r.pair[at] == key, r.rank[at], -1)


def merge_rows(r: Ranks, pieces: list[bytes], width: int) -> list[list[int]]:
    """Merge pieces of at most ``width`` bytes (a power of two) together."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    ids = np.zeros((n, width), np.int64)
    inside = np.arange(width) < size[:, None]
    ids[inside] = r.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    nxt = np.tile(np.arange(1, width + 1), (n, 1))
    prv = nxt - 2
    live = inside.copy()
    tree = np.full((n, 2 * width), NONE)
    row, pos = np.nonzero(inside[:, 1:])
    rank = _pair_ranks(r, ids[row, pos], ids[row, pos + 1])
    tree[row, width + pos] = np.where(rank >= 0, rank * width + pos, NONE)
    for level in range(width.bit_length() - 2, -1, -1):
        a = 1 << level
        tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])

    def update(rows: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
        at = pos + width
        tree[rows, at] = value
        while width > 1 and at.size and at[0] > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def leaf(rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
        right = nxt[rows, pos]
        has = right < size[rows]
        rank = _pair_ranks(r, ids[rows, pos], ids[rows, np.where(has, right, pos)])
        return np.where(has & (rank >= 0), rank * width + pos, NONE)

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        best = tree[rows, 1]
        pos = best % width
        right = nxt[rows, pos]
        after = nxt[rows, right]
        ids[rows, pos] = best // width
        live[rows, right] = False
        nxt[rows, pos] = after
        more = after < size[rows]
        prv[rows[more], after[more]] = pos[more]
        update(rows, right, np.full(len(rows), NONE))
        update(rows, pos, leaf(rows, pos))
        left = prv[rows, pos]
        has = left >= 0
        update(rows[has], left[has], leaf(rows[has], left[has]))
        rows = rows[tree[rows, 1] < NONE]
    flat, ends = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge_long(r: Ranks, piece: bytes) -> list[int]:
    """The same tree for one long piece."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    none, get = int(NONE), r.by_pair.get
    ids = r.byte_id[np.frombuffer(piece, np.uint8)].tolist()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n
    tree = [none] * (2 * width)

    def leaf(pos: int) -> int:
        rank = get(ids[pos] << 32 | ids[nxt[pos]]) if nxt[pos] < n else None
        return none if rank is None else rank * width + pos

    def update(pos: int, value: int) -> None:
        at = pos + width
        tree[at] = value
        while at > 1:
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b

    for i in range(n):
        tree[width + i] = leaf(i)
    for at in range(width - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    while tree[1] != none:
        rank, pos = divmod(tree[1], width)
        right = nxt[pos]
        ids[pos], live[right], nxt[pos] = rank, False, nxt[right]
        if nxt[pos] < n:
            prv[nxt[pos]] = pos
        update(right, none)
        update(pos, leaf(pos))
        if prv[pos] >= 0:
            update(prv[pos], leaf(prv[pos]))
    return [i for i, x in zip(ids, live, strict=True) if x]


def encode_pieces(r: Ranks, pieces: list[bytes]) -> list[list[int]]:
    """Ids of each piece; a piece that is a token is that token."""
    out: list[list[int] | None] = [[r.by_bytes[p]] if p in r.by_bytes else None for p in pieces]
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if out[i] is None:
            if not p:
                out[i] = []
            elif len(p) > ROW_BYTES:
                out[i] = merge_long(r, p)
            else:
                by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
    for width, at in by_width.items():
        for a in range(0, len(at), ROWS):
            part = at[a : a + ROWS]
            for i, ids in zip(part, merge_rows(r, [pieces[i] for i in part], width), strict=True):
                out[i] = ids
    return out


@functools.lru_cache(maxsize=2)
def rank_cache(name: str, folder: str | None = None) -> SegmentCache:
    """Segment cache that encodes through the segment tree."""
    import public_tokenizers
    import regex

    r, matches = load(name, folder), regex.compile(public_tokenizers.PATTERN).findall

    def encode(parts: list[str]) -> list[list[int]]:
        cut = [[p] if PLAIN.fullmatch(p) or p.strip(".,;:!?") == "" else matches(p) for p in parts]
        todo = list(dict.fromkeys(m.encode("utf-8", "surrogatepass") for ms in cut for m in ms))
        ids = dict(zip(todo, encode_pieces(r, todo), strict=True))
        return [[i for m in ms for i in ids[m.encode("utf-8", "surrogatepass")]] for ms in cut]

    return SegmentCache(SPACED, encode)


def encode_texts(texts: list[str], name: str, folder: str | None = None) -> list[np.ndarray]:
    cache = rank_cache(name, folder)
    cache.trim()
    cache.learn(set().union(*map(cache.cut.findall, texts)))
    return [np.frombuffer(x, "<u4") for x in cache.join(texts)]  # not of(): it might drop what was just learned


def decode(ids: list[int], r: Ranks) -> bytes:
    return b"".join(map(r.by_id.__getitem__, ids))


def round_trip(docs: DataFrame, name: str, folder: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode every text: ``ids`` and ``decoded`` bytes."""

    def fn(texts: list[str]) -> dict:
        ids = [x.tolist() for x in encode_texts(texts, name, folder)]
        return {"ids": ids, "decoded": [decode(x, load(name, folder)) for x in ids]}

    return map_texts(docs, fn, "ids array<int>, decoded binary", keep)


def digests(docs: DataFrame, name: str, folder: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``round_trip`` with digests in the place of ids and bytes, taken in the
    task so that the ids need not leave it."""

    def fn(texts: list[str]) -> dict:
        r = load(name, folder)
        text_of = _decimals(len(r.by_id)).__getitem__
        ids = [x.tolist() for x in encode_texts(texts, name, folder)]
        return {
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [hashlib.sha256(",".join(map(text_of, x)).encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(decode(x, r)).hexdigest() for x in ids],
        }

    return map_texts(docs, fn, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep)


@functools.lru_cache(maxsize=2)
def _decimals(n: int) -> list[str]:
    return list(map(str, range(n)))
