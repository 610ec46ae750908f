"""Best-fit packing after Martello-Toth dominance reduction.

Sequences hold ``capacity`` tokens, so a piece has one of ``capacity`` lengths
and the packing problem is the histogram of lengths: at most ``capacity``
counts, whatever the corpus.  ``plan`` solves it on the driver in runs: a run
says that the next ``k`` pieces of one length go, one each, into ``k``
consecutive sequences at one offset.  Pieces find their run by their number
within their length, which comes from per-partition counts and prefix sums;
no length, however common, is ever brought together.

Null texts are empty texts (one end id); null and repeated ids are legal and
each row is packed; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import trim_memory
from ..session import ship_package
from .common import pieces_of, saved
from .vocab import library_cache, release

CAPACITY = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, pid int, nth bigint"
#: (length, pieces, first sequence, offset)
Run = tuple[int, int, int, int]


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, vocab_folder: str | None = None) -> DataFrame:
    """Encode (doc_id, text); cut documents longer than ``capacity``, the
    first piece being the short one; ``nth`` numbers a length's pieces within
    the task ``pid``.  The ids themselves stay in the task."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        pid, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        cache, end = library_cache(vocabulary, vocab_folder), np.uint32(end_id).tobytes()
        for batch in batches:
            for part in pieces_of(batch):
                rows: list[list] = [[] for _ in range(7)]
                ids = part.column("doc_id").to_pylist()
                for doc, x in zip(ids, cache.of([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    x += end
                    n = len(x) // 4
                    at, length = 0, (n - 1) % capacity + 1
                    for piece in range((n + capacity - 1) // capacity):
                        crc = zlib.crc32(x[4 * at : 4 * (at + length)])
                        for col, v in zip(rows, (doc, piece, at, length, crc, pid, seen[length]), strict=True):
                            col.append(v)
                        seen[length] += 1
                        at, length = at + length, capacity
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"],
                )
        trim_memory()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Packing of ``counts[length]`` pieces as runs, in the order in which a
    length's pieces are dealt out."""
    left = {s: c for s, c in counts.items() if c > 0}
    sizes = sorted(left)
    runs: list[Run] = []
    bins = 0

    def take(s: int, k: int) -> None:
        left[s] -= k
        if not left[s]:
            del left[s]
            sizes.pop(bisect_left(sizes, s))

    def fix(items: tuple[int, ...], k: int) -> None:
        nonlocal bins
        at = 0
        for s in items:
            runs.append((s, k, bins, at))
            take(s, k)
            at += s
        bins += k

    def smallest(n: int, without: int) -> list[int]:
        """The n smallest pieces besides one of size ``without``."""
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n - len(out), left[s] - (s == without))
            if len(out) == n:
                break
        return out

    def best_pair(room: int, without: int) -> int:
        """Largest sum of two pieces that fits into ``room``."""
        best, i, j = 0, 0, bisect_left(sizes, room) - 1
        free = {s: left[s] - (s == without) for s in sizes[: j + 1]}
        while i <= j:
            a, b = sizes[i], sizes[j]
            if a + b > room or free[b] < 1:
                j -= 1
                continue
            if free[a] >= (2 if i == j else 1):
                best = max(best, a + b)
            i += 1
        return best

    # Martello-Toth: a set that holds j and dominates every feasible set with
    # j is in some best packing; fix it and go on with the smaller instance
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left:
                room = capacity - j
                small = smallest(3, j)
                if not small or small[0] > room:
                    fix((j,), 1 if left[j] > 1 and j <= room else left[j])
                    changed = True
                    continue
                i = bisect_left(sizes, room + 1) - 1
                if sizes[i] == j and left[j] < 2:
                    i -= 1
                k = sizes[i]
                pairs = left[j] // 2 if k == j else min(left[j], left[k])
                if k == room or sum(small[:2]) > room or len(small) < 2:
                    pass  # an exact fit, or no set holds two more pieces
                elif len(small) < 3 or sum(small) > room:
                    if k < best_pair(room, j):
                        break
                else:
                    break
                fix((j, k), pairs)
                changed = True

    # best fit, largest first: open[r] holds runs of alike sequences with room r
    open_runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put(room: int, first: int, k: int) -> None:
        if k and room:
            if room not in open_runs:
                open_runs[room] = []
                insort(rooms, room)
            open_runs[room].append((first, k))

    for s in reversed(sizes):
        c = left[s]
        while c:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, bins, -(-c // (capacity // s))
                bins += n
            each = min(room // s, c)  # best fit fills one sequence before the next
            full = min(n, c // each)
            for i in range(each):
                runs.append((s, full, first, capacity - room + i * s))
            c -= full * each
            put(room - each * s, first, full)
            rest = min(c, room // s) if full < n and c < each else 0
            for i in range(rest):
                runs.append((s, 1, first + full, capacity - room + i * s))
            c -= rest
            put(room - rest * s, first + full, 1 if rest else 0)
            put(room, first + full + bool(rest), n - full - bool(rest))
    return runs


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, vocab_folder: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset`` (its place there)."""
    spark = docs.sparkSession
    pieces = saved(token_pieces(docs, vocabulary, end_id, capacity, vocab_folder), "pieces")
    per_task = pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` rows reach the driver
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(counts, capacity), key=lambda r: r[0])  # stable: a length's runs stay in order
    length, k, first, offset = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 4
    # a piece's key: length, then number; runs of a length begin at their first key
    start = np.cumsum(k) - k
    lead = np.r_[True, length[1:] != length[:-1]] if len(length) else np.zeros(0, bool)
    start -= np.repeat(start[lead], np.diff(np.r_[np.flatnonzero(lead), len(length)])) if len(length) else 0
    stride = np.int64(1 << 40)
    keys = length * stride + start

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nth = b.column("nth").to_numpy() + b.column("base").to_numpy()
            at = np.searchsorted(keys, b.column("length").to_numpy() * stride + nth, side="right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(first[at] + nth - start[at]), pa.array(offset[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ship_package(spark)
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return pieces.join(base, ["pid", "length"]).mapInArrow(place, out)
