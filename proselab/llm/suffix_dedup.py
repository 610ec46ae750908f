"""Removal of byte strings that an earlier document holds (suffix-array dedup).

A byte is removed if some ``LENGTH``-byte string over it also starts in a
document with a smaller id.  Comparing every suffix of the corpus is out of
reach, so suffixes are taken at anchors: the positions whose ``GRAM``-byte
hash is the least of a window, chosen so that every LENGTH-byte string holds
an anchor, the same one wherever the string stands.

1. Each group of documents reports its distinct anchor hashes, by hash bucket;
   the buckets answer which hashes several documents hold.
2. Each group sends the distinct contexts (LENGTH-byte strings around it) of
   its shared anchors, with the smallest document that has them.
3. Each bucket sorts the suffixes that begin at its anchors, and the reversed
   prefixes that end there.  The sort is a mergesort whose comparisons find
   the common extension of two suffixes by binary search over their prefix
   polynomial hashes, a logarithmic number of probes; neighbours' extensions
   are verified on the bytes, and a bucket with a hash collision is sorted by
   its bytes instead.  Two anchors share the string that begins d bytes before
   them if they agree on d bytes to the left and LENGTH - d to the right, so
   runs of the two sorted orders give, for each d, the smallest document.
4. Each group marks the strings that an earlier document has.

An anchor hash with more than HOT_CONTEXTS contexts (a short string in very many
documents, whose surroundings differ) is not sorted in one place: each group
finds the smallest document of every LENGTH-byte string at its hot anchors and
sends the string's 128-bit digest with it, so the strings, not the anchors, are
what buckets share out.

All exchanged rows are per (group, bucket) and hold what is distinct there: a
passage that a third of all documents share reaches a bucket once per group and
string.
The three steps over texts share one shuffle of them.

Null texts are empty.  A null id counts as larger than every id; rows that
share an id never remove from each other.  Texts shorter than LENGTH and empty
tables give rows with nothing removed.  Matches never cross documents.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import total_bytes
from .vocab import forget, kept

LENGTH = 50
GRAM = 20
#: anchors are least of so many neighbouring positions
WINDOW = LENGTH - GRAM + 1
#: the string may begin so many bytes before its anchor
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
#: bytes of text in a group of documents
GROUP_BYTES = 1 << 20
KEPT_POWERS = 3 << 19
#: groups whose anchors fit one bucket
GROUPS_A_BUCKET = 4
#: contexts compared or sorted at a time
SORTED_ROWS = 1 << 14
#: contexts of one anchor hash that one task sorts, at most
HOT_CONTEXTS = SORTED_ROWS
LEAST_GROUPS, LEAST_BUCKETS = 48, 24
NO_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; one table serves
    all groups but those around a very long text."""
    return _table_of_powers(n) if n > KEPT_POWERS else _kept_powers()


@kept(1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _table_of_powers(KEPT_POWERS)


def _table_of_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


class Group:
    """The documents of one group as one byte array, in order of their ids."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids = ids
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.pos = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        n = len(self.flat)
        if n < LENGTH:
            return
        power, inverse = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        sums[1:] = _letters()[self.flat]
        sums[1:] *= power[:n]
        np.cumsum(sums, out=sums)
        self.sums, self.inverse = sums, inverse
        h = sums[GRAM:] - sums[:-GRAM]
        h *= inverse[: n - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h |= np.uint64(1)
        least = _sliding(h, WINDOW, np.minimum)  # of the window that begins here
        # strings that would run over the end of their document do not count
        for a, z in zip(self.start.tolist(), self.end.tolist(), strict=True):
            least[max(a, z - LENGTH + 1) : z] = 0
        edge = np.zeros(WINDOW - 1, np.uint64)
        chosen = _sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == h
        self.pos = np.flatnonzero(chosen)
        self.hash = h[self.pos]
        self.doc = np.searchsorted(self.end, self.pos, side="right")

    def context_bounds(self, pos: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes to the left and right of anchors, within their documents."""
        return np.minimum(LEFT, pos - self.start[doc]), np.minimum(LENGTH, self.end[doc] - pos)

    def contexts(self, pos: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Context bytes; column LEFT is the anchor, 0 beyond the document."""
        at = pos[:, None] + np.arange(-LEFT, LENGTH)
        out = self.flat[np.clip(at, 0, max(0, len(self.flat) - 1))] if len(pos) else np.zeros((0, WIDTH), np.uint8)
        column = np.arange(-LEFT, LENGTH)
        out[(column < -left[:, None]) | (column >= right[:, None])] = 0
        return out

    def same_context(self, pos: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First anchors with each distinct context, and for every anchor the
        place of its context's first among them."""
        left, right = self.context_bounds(pos, doc)
        key = (self.sums[pos + right] - self.sums[pos - left]) * self.inverse[pos - left] if len(pos) else np.zeros(0, np.uint64)
        key = (key ^ (key >> np.uint64(31))) * _MIX + (left * 64 + right).astype(np.uint64)
        _, first, inv = np.unique(key, return_index=True, return_inverse=True)
        again = np.flatnonzero(first[inv] != np.arange(len(pos)))
        for a in range(0, len(again), SORTED_ROWS):
            x = again[a : a + SORTED_ROWS]
            y = first[inv[x]]
            same = (left[x] == left[y]) & (right[x] == right[y])
            same &= (self.contexts(pos[x], left[x], right[x]) == self.contexts(pos[y], left[y], right[y])).all(axis=1)
            if not same.all():  # a collision: tell contexts apart by their bytes
                rows = np.concatenate([self.contexts(pos, left, right), left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
                _, first, inv = np.unique(_void(rows), return_index=True, return_inverse=True)
                break
        return first, inv


def _void(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()


def _group(table: pa.Table) -> tuple[Group, pa.Table]:
    """The group of a table, and the table in the group's order."""
    forget()
    ids = table.column("__id")
    text = table.column("__text")
    order = np.array(sorted(range(table.num_rows), key=list(zip(ids.to_pylist(), text.to_pylist(), strict=True)).__getitem__), np.int64)
    table = table.take(pa.array(order))
    texts = [t.encode("utf-8", "surrogatepass") for t in table.column("__text").to_pylist()]
    return Group(table.column("__id").to_numpy(), texts), table


# ------------------------------------------------------------- suffix sorting


class Suffixes:
    """Strings with prefix polynomial hashes, compared by common extension."""

    def __init__(self, chars: np.ndarray, size: np.ndarray):
        self.chars, self.size = chars, size
        n, width = chars.shape
        self.width = width
        power, _ = _powers(128)
        self.prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum(_letters()[chars] * power[:width], axis=1, out=self.prefix[:, 1:])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix, by binary search over the hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        for _ in range(int(self.width).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.prefix[x, mid] == self.prefix[y, mid]
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        e = self.extension(x, y)
        at = np.minimum(e, self.width - 1)
        inside = (e < self.size[x]) & (e < self.size[y])
        return np.where(inside, self.chars[x, at] < self.chars[y, at], (e == self.size[x]) & (e < self.size[y]))

    def merge_sort(self, family: np.ndarray) -> np.ndarray:
        """Order of the strings within each family (a sorted array of family
        numbers); all merges of a level run together."""
        n = len(family)
        order = np.arange(n)
        begin = np.searchsorted(family, family, side="left")
        size = np.searchsorted(family, family, side="right") - begin
        place = np.arange(n) - begin
        run = 1
        while (size > run).any():
            p = np.flatnonzero(size > run)
            w, b, s = place[p], begin[p], size[p]
            first = (w // (2 * run)) * 2 * run  # of the pair of runs
            right = (w - first) >= run
            low = np.where(right, first, np.minimum(first + run, s))
            high = np.where(right, first + run, np.minimum(first + 2 * run, s))
            start = low.copy()
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                other, mine = order[b[todo] + mid], order[p[todo]]
                # equal strings keep their order: the left run's come first
                before = np.where(right[todo], ~self.less(mine, other), self.less(other, mine))
                low[todo] = np.where(before, mid + 1, low[todo])
                high[todo] = np.where(before, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            new = b + first + (w - first - run * right) + (low - start)
            moved = order.copy()
            moved[new] = order[p]
            order = moved
            run *= 2
        return order

    def sort(self, family: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order, and common extension with the one before (-1 at the first of
        a family); verified on the bytes."""
        order = self.merge_sort(family)
        common = self._neighbours(order, family)
        x, y = order[:-1], order[1:]
        inside = family[1:] == family[:-1]
        at = np.minimum(common[1:], self.width - 1)
        size_x, size_y = self.size[x], self.size[y]
        ended = (common[1:] == size_x) & (size_x <= size_y)
        rising = (common[1:] < np.minimum(size_x, size_y)) & (self.chars[x, at] < self.chars[y, at])
        hashed = self.extension(x, y)
        if (inside & (~(ended | rising) | (hashed != common[1:]))).any():
            rows = np.concatenate([self.chars, self.size[:, None].astype(np.uint8)], axis=1)
            order = np.lexsort((*rows.T[::-1], family))
            common = self._neighbours(order, family)
        return order, common

    def _neighbours(self, order: np.ndarray, family: np.ndarray) -> np.ndarray:
        """Common prefix with the string before, byte by byte."""
        common = np.full(len(order), -1, np.int64)
        for a in range(1, len(order), 1 << 17):
            x, y = order[a - 1 : a - 1 + (1 << 17)], order[a : a + (1 << 17)]
            x = x[: len(y)]
            differ = self.chars[x] != self.chars[y]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)
            common[a : a + len(y)] = np.minimum(first, np.minimum(self.size[x], self.size[y]))
        common[1:][family[1:] != family[:-1]] = -1
        return common


def smallest_documents(context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, family: np.ndarray) -> np.ndarray:
    """For distinct contexts, sorted by the family of their anchor: the
    smallest document that holds the LENGTH-byte string beginning d bytes
    before the anchor, d = 0 .. LEFT (NO_ID where the context has none)."""
    n = len(doc)
    d = np.arange(LEFT + 1)
    valid = (d <= left[:, None]) & (LENGTH - d <= right[:, None])
    out = np.where(valid, doc[:, None], NO_ID)
    order_a, common_a = Suffixes(context[:, LEFT:], right).sort(family)
    order_b, common_b = Suffixes(np.ascontiguousarray(context[:, :LEFT][:, ::-1]), left).sort(family)
    class_a, class_b = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(LEFT + 1):
        class_a[order_a] = np.cumsum(common_a < LENGTH - k)
        class_b[order_b] = np.cumsum(common_b < k)
        at = np.flatnonzero(valid[:, k])
        key = class_a[at] * (n + 1) + class_b[at]
        o = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1]]) if len(o) else o
        if len(first):
            low = np.minimum.reduceat(doc[at][o], first)
            out[at[o], k] = np.repeat(low, np.diff(np.r_[first, len(o)]))
    return out


def family_slices(family: np.ndarray):
    """Slices of a sorted family array that end where families end."""
    a = 0
    while a < len(family):
        z = min(len(family), a + SORTED_ROWS)
        z = int(np.searchsorted(family, family[z - 1], side="right"))
        yield slice(a, z)
        a = z


# ------------------------------------------------------------------ the steps

_HASHES = "bucket int, grp int, hashes binary, counts binary"
_SHARED = "grp int, hashes binary, hot binary"
# kind: contexts to be sorted; strings at hot anchors (context: digests, left
# and right: the anchor's offset); or spans (left to right) that a group found
_CONTEXTS = "bucket int, grp int, kind int, context binary, left binary, right binary, doc binary, pos binary"
SORTED, STRINGS, SPANS = range(3)
_FOUND = "grp int, pos binary, low binary, high binary"


def _table(ddl: str, columns: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each anchor hash.  An anchor is the least hash of its
    neighbours, so its high bits are near zero: it is mixed once more."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _slices(bucket: np.ndarray):
    """(bucket, slice) of a sorted bucket array."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, z in zip(first, np.r_[first[1:], len(bucket)], strict=True) if len(bucket) else ():
        yield int(bucket[a]), slice(int(a), int(z))


def _join(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _report(n_buckets: int):
    def report(table: pa.Table) -> pa.Table:
        g, _ = _group(table)
        grp = table.column("__grp")[0].as_py()
        order = np.lexsort((g.doc, g.hash))
        h, ids = g.hash[order], g.ids[g.doc[order]]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(h)] - 1
        several = ids[first] != ids[last] if len(h) else np.zeros(0, bool)
        # at most 2**(counts >> 1) anchors; the lowest bit: in several documents
        counts = (2 * np.ceil(np.log2(last - first + 1)) + several).astype("u1")
        bucket = _buckets(h[first], n_buckets)
        order = np.argsort(bucket, kind="stable")
        h, counts = h[first][order], counts[order]
        rows: list[list] = [[], [], [], []]
        for b, s in _slices(bucket[order]):
            for c, v in zip(rows, (b, grp, h[s].tobytes(), counts[s].tobytes()), strict=True):
                c.append(v)
        return _table(_HASHES, rows)

    return report


def _answer(hot_contexts: int):
    def answer(table: pa.Table) -> pa.Table:
        parts = table.column("hashes").to_pylist()
        h, counts = _join(table, "hashes", "u8"), _join(table, "counts", "u1")
        grp = np.repeat(table.column("grp").to_numpy(), [len(p) // 8 for p in parts])
        order = np.argsort(h, kind="stable")
        hs, counts = h[order], counts[order]
        first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        n = np.diff(np.r_[first, len(hs)])
        shared = np.repeat((n > 1) | np.logical_or.reduceat((counts & 1).astype(bool), first), n)
        hot = np.repeat(np.add.reduceat(np.int64(1) << (counts >> 1).astype(np.int64), first) > hot_contexts, n)
        hs, gs, hot = hs[shared], grp[order][shared], hot[shared]
        order = np.lexsort((hs, gs))
        hs, gs, hot = hs[order], gs[order], hot[order]
        cut = list(_slices(gs))
        return _table(_SHARED, [[g for g, _ in cut], [hs[s].tobytes() for _, s in cut], [hot[s].tobytes() for _, s in cut]])

    return answer


def _pack(b: int, grp: int, kind: int, blob: bytes, left: np.ndarray, right: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple:
    return (
        b, grp, kind, blob, left.astype("u1").tobytes(), right.astype("u1").tobytes(),
        doc.astype("<i8").tobytes(), pos.astype("<i8").tobytes(),
    )


def _hot_strings(g: Group, x: np.ndarray, grp: int, n_buckets: int) -> list[tuple]:
    """Rows for the strings at hot anchors: each string's smallest document
    in this group asks its bucket; the later ones are found here."""
    pos, doc, ids = g.pos[x], g.doc[x], g.ids[g.doc[x]]
    left, right = g.context_bounds(pos, doc)
    context = g.contexts(pos, left, right)
    lo, hi = np.full(len(x), LEFT + 1), np.full(len(x), -1)
    digests, asks, offsets = [], [], []
    for d in range(LEFT + 1):
        at = np.flatnonzero((d <= left) & (LENGTH - d <= right))
        if not len(at):
            continue
        strings = _void(context[at, LEFT - d : LEFT - d + LENGTH])
        distinct, inv = np.unique(strings, return_inverse=True)
        low = np.full(len(distinct), NO_ID)
        np.minimum.at(low, inv, ids[at])
        later = low[inv] < ids[at]
        lo[at[later]] = np.minimum(lo[at[later]], d)
        hi[at[later]] = d
        digest = b"".join([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in distinct])
        digests.append(np.frombuffer(digest, "<u8").reshape(-1, 2)[inv[~later]])
        asks.append(at[~later])
        offsets.append(np.full(len(asks[-1]), d))
    rows = []
    if asks:
        key, ask, off = np.concatenate(digests), np.concatenate(asks), np.concatenate(offsets)
        bucket = _buckets(key[:, 0], n_buckets)
        order = np.argsort(bucket, kind="stable")
        for b, s in _slices(bucket[order]):
            o = order[s]
            rows.append(_pack(b, grp, STRINGS, key[o].tobytes(), off[o], off[o], ids[ask[o]], pos[ask[o]]))
    if len(f := np.flatnonzero(hi >= 0)):
        rows.append(_pack(grp % n_buckets, grp, SPANS, b"", lo[f], hi[f], ids[f], pos[f]))
    return rows


def _send(n_buckets: int):
    def send(texts: pa.Table, shared: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if texts.num_rows and shared.num_rows:
            g, _ = _group(texts)
            known = _join(shared, "hashes", "u8")
            order = np.argsort(known)
            known, hot = known[order], _join(shared, "hot", "?")[order]
            at = np.minimum(np.searchsorted(known, g.hash), len(known) - 1)
            mine = np.flatnonzero(known[at] == g.hash)
            first, _ = g.same_context(g.pos[mine], g.doc[mine])
            mine = mine[first]
            mine = mine[np.argsort(g.hash[mine], kind="stable")]
            grp = texts.column("__grp")[0].as_py()
            hottest, mine = mine[hot[at[mine]]], mine[~hot[at[mine]]]
            bucket = _buckets(g.hash[mine], n_buckets)
            order = np.argsort(bucket, kind="stable")
            for b, s in _slices(bucket[order]):
                x = mine[order[s]]
                pos, doc = g.pos[x], g.doc[x]
                left, right = g.context_bounds(pos, doc)
                blob = g.contexts(pos, left, right).tobytes()
                rows.append(_pack(b, grp, SORTED, pa.compress(blob, codec="zstd", asbytes=True), left, right, g.ids[doc], pos))
            if len(hottest):
                rows += _hot_strings(g, hottest, grp, n_buckets)
        return _table(_CONTEXTS, [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)])

    return send


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Group, offsets, document and place of every entry."""
    sizes = [len(x) for x in table.column("left").to_pylist()]
    left, right = (_join(table, c, "u1").astype(np.int64) for c in ("left", "right"))
    return np.repeat(table.column("grp").to_numpy(), sizes), left, right, _join(table, "doc", "<i8"), _join(table, "pos", "<i8")


def _resolve(table: pa.Table) -> pa.Table:
    kind = table.column("kind").to_numpy()
    parts = [_resolve_contexts, _resolve_strings, _columns_of_spans]
    found = [part(table.filter(pa.array(kind == k))) for k, part in enumerate(parts) if (kind == k).any()]
    grp, pos, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(grp, kind="stable")
    grp, pos, lo, hi = grp[order], pos[order].astype("<i8"), lo[order].astype("u1"), hi[order].astype("u1")
    cut = list(_slices(grp))
    return _table(_FOUND, [[g for g, _ in cut], *([c[s].tobytes() for _, s in cut] for c in (pos, lo, hi))])


def _columns_of_spans(table: pa.Table) -> tuple[np.ndarray, ...]:
    grp, lo, hi, _, pos = _columns(table)
    return grp, pos, lo, hi


def _resolve_strings(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Strings at hot anchors that a smaller document of another group has."""
    key = _join(table, "context", "<u8").reshape(-1, 2)
    grp, off, _, doc, pos = _columns(table)
    order = np.lexsort((doc, key[:, 1], key[:, 0]))
    sorted_key = key[order]
    first = np.flatnonzero(np.r_[True, (sorted_key[1:] != sorted_key[:-1]).any(axis=1)])
    low = np.repeat(doc[order][first], np.diff(np.r_[first, len(order)]))
    hit = order[low < doc[order]]
    return grp[hit], pos[hit], off[hit], off[hit]


def _resolve_contexts(table: pa.Table) -> tuple[np.ndarray, ...]:
    grp, left, right, doc, pos = _columns(table)
    sizes = [len(x) for x in table.column("left").to_pylist()]
    blobs = zip(table.column("context").to_pylist(), sizes, strict=True)
    context = np.frombuffer(b"".join(pa.decompress(c, n * WIDTH, codec="zstd", asbytes=True) for c, n in blobs), np.uint8).reshape(-1, WIDTH)
    # contexts that several groups sent, once, with their smallest document
    rows = np.concatenate([context, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
    _, first, inv = np.unique(_void(rows), return_index=True, return_inverse=True)
    del rows
    low = np.full(len(first), NO_ID)
    np.minimum.at(low, inv, doc)
    # strings of the same context in a smaller document
    lo, hi = np.maximum(0, LENGTH - right), left.copy()
    hit = (low[inv] < doc) & (lo <= hi)
    # strings of the same anchor's other contexts
    _, family, size = np.unique(_void(context[first, LEFT : LEFT + GRAM]), return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[family] > 1)
    several = several[np.argsort(family[several], kind="stable")]
    sent = np.argsort(inv, kind="stable")
    begin, end = np.searchsorted(inv[sent], several, side="left"), np.searchsorted(inv[sent], several, side="right")
    for s in family_slices(family[several]):
        c = several[s]
        smallest = smallest_documents(context[first[c]], left[first[c]], right[first[c]], low[c], family[c])
        n = end[s] - begin[s]
        row = sent[np.repeat(begin[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        earlier = smallest[np.repeat(np.arange(len(c)), n)] < doc[row, None]
        hit[row] = earlier.any(axis=1)
        lo[row] = earlier.argmax(axis=1)
        hi[row] = LEFT - earlier[:, ::-1].argmax(axis=1)
    hit = np.flatnonzero(hit)
    return grp[hit], pos[hit], lo[hit], hi[hit]


def _remove(columns: list[str], as_text: bool):
    def remove(texts: pa.Table, found: pa.Table) -> pa.Table:
        g, texts = _group(texts)
        gone = np.zeros(len(g.flat) + 1, np.int64)
        if len(g.pos):
            first, inv = g.same_context(g.pos, g.doc)
            chief = first[inv]
            # a later document of the group has all strings of the context
            left, right = g.context_bounds(g.pos, g.doc)
            low, high = LENGTH - right, left.copy()
            here = (g.ids[g.doc] > g.ids[g.doc[chief]]) & (np.maximum(low, 0) <= high)
            low = np.maximum(low, 0)
            # the smallest one those that a smaller document elsewhere has
            if found.num_rows:
                where = np.searchsorted(g.pos, _join(found, "pos", "<i8"))
                # an anchor's strings all hold it, so its spans are one
                lo, hi = np.full(len(g.pos), LENGTH), np.full(len(g.pos), -1)
                np.minimum.at(lo, where, _join(found, "low", "u1").astype(np.int64))
                np.maximum.at(hi, where, _join(found, "high", "u1").astype(np.int64))
                ask = ~here & (g.ids[g.doc] == g.ids[g.doc[chief]]) & (hi[chief] >= 0)
                low, high = np.where(ask, lo[chief], low), np.where(ask, hi[chief], high)
                here |= ask
            np.add.at(gone, (g.pos - high)[here], 1)
            np.subtract.at(gone, (g.pos - low)[here] + LENGTH, 1)
        mask = np.cumsum(gone)[:-1] > 0
        begins = mask & ~np.r_[False, mask[:-1]]
        begins[g.start[g.start < g.end]] = mask[g.start[g.start < g.end]]
        total, spans = np.r_[0, np.cumsum(mask)], np.r_[0, np.cumsum(begins)]
        kept = [g.flat[a:z][~mask[a:z]].tobytes() for a, z in zip(g.start, g.end, strict=True)]
        out = {c: texts.column(c) for c in columns}
        out |= {
            "n_bytes": pa.array(g.end - g.start),
            "n_removed": pa.array(total[g.end] - total[g.start]),
            "n_spans": pa.array(spans[g.end] - spans[g.start]),
        }
        if as_text:
            out["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
        else:
            out["kept_bytes"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return remove


def dedup(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), as_text: bool = False, group_bytes: int = GROUP_BYTES, hot_contexts: int = HOT_CONTEXTS
) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id, text), ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept_bytes`` of every row; with
    ``as_text``, ``kept_text`` instead, without the characters cut apart.

    ``group_bytes`` suits Python workers of some 400 MB, which hold about 70
    times as much.  Exchanged rows number up to groups times buckets, so with
    larger workers raise it with the corpus: ten times the group means a
    hundredth of the rows, each a hundred times as full."""
    ship_package(docs.sparkSession)
    groups = max(LEAST_GROUPS, -(-total_bytes(docs) // group_bytes))
    n_buckets = max(LEAST_BUCKETS, groups // GROUPS_A_BUCKET)
    texts = docs.select(
        *keep,
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NO_ID))).alias("__id"),
        F.coalesce("text", F.lit("")).alias("__text"),
        F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(3)), F.lit(groups)).cast("int").alias("__grp"),
    )
    by_group = texts.groupBy("__grp")
    hashes = by_group.applyInArrow(_report(n_buckets), _HASHES)
    shared = hashes.groupBy("bucket").applyInArrow(_answer(hot_contexts), _SHARED)
    contexts = by_group.cogroup(shared.groupBy("grp")).applyInArrow(_send(n_buckets), _CONTEXTS)
    found = contexts.groupBy("bucket").applyInArrow(_resolve, _FOUND)
    schema = docs.select(*keep).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_text", "string") if as_text else ("kept_bytes", "binary")):
        schema = schema.add(name, kind)
    return by_group.cogroup(found.groupBy("grp")).applyInArrow(_remove(list(keep), as_text), schema)
