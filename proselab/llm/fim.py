"""Fill-in-the-middle transformation over a Roaring-style boundary set.

A text is cut into units (a run of ASCII letters, or any other single
character).  The ends of its units, in code points, go into a compressed
ordered set: containers by the high 16 bits, each an array, a bitmap or a list
of runs, whichever is smallest, with cumulative cardinalities before them.
``select(k)`` finds the container by binary search and the place inside it by
a local select, so both cuts of a document are two lookups.

The cuts and the form depend on the id alone: groups of eight hexadecimal
digits of sha256(``seed:id``).  Defined cases: a null text is an empty text and
stays plain; a text that holds one of the marks stays plain, so that every
output can be taken apart again; a null id hashes as the empty string; repeated
rows are transformed alike; further columns are not read; an empty table gives
an empty table.  Texts of any length are handled whole (about 6 bytes of
working memory a character).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..session import ship_package
from .common import pieces_of

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: per cent of the documents that are cut, and of those that put the suffix first
CUT_PERCENT, SPM_PERCENT = 90, 20
#: values of an array container at most; a bitmap is never larger
ARRAY_MOST = 4096
WORDS = 1024


class ArrayContainer(NamedTuple):
    values: np.ndarray  # uint16, rising

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer(NamedTuple):
    words: np.ndarray  # 1024 x uint64
    before: np.ndarray  # set bits before each word

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, side="right")) - 1
        word = int(self.words[w])
        for _ in range(k - int(self.before[w])):
            word &= word - 1  # drop the lowest set bit
        return 64 * w + (word & -word).bit_length() - 1


class RunContainer(NamedTuple):
    starts: np.ndarray
    before: np.ndarray  # values before each run

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[r]) + k - int(self.before[r])


def container(low: np.ndarray):
    """The smallest container for rising 16-bit values."""
    lead = np.flatnonzero(np.r_[True, np.diff(low) != 1])
    size = {RunContainer: 4 * len(lead), ArrayContainer: 2 * len(low), BitmapContainer: 8 * WORDS}
    kind = min(size, key=size.get)
    if kind is RunContainer:
        return RunContainer(low[lead].astype(np.uint16), lead.astype(np.int32))
    if kind is ArrayContainer:
        return ArrayContainer(low.astype(np.uint16))
    bits = np.zeros(64 * WORDS, bool)
    bits[low] = True
    words = np.packbits(bits, bitorder="little").view("<u8")
    count = np.bitwise_count(words).astype(np.int64)
    return BitmapContainer(words, np.cumsum(count) - count)


class BoundarySet:
    """A compressed set of rising non-negative integers."""

    def __init__(self, values: np.ndarray):
        high = values >> 16
        first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(values) else np.zeros(0, np.int64)
        self.keys = high[first].tolist()
        self.before = np.r_[first, len(values)]
        self.containers = [container(values[a:b] & 0xFFFF) for a, b in zip(first, self.before[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest value, from 0."""
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        return (self.keys[c] << 16) + self.containers[c].select(k - int(self.before[c]))


def unit_ends(text: str) -> np.ndarray:
    """Code-point offsets at which a unit ends, rising."""
    c = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    folded = c | 0x20  # upper to lower case; moves no other character into a-z
    letter = (folded >= 97) & (folded <= 122)
    inside = letter[:-1] & letter[1:]
    return np.r_[np.flatnonzero(~inside) + 1, len(c)] if len(c) else np.zeros(0, np.int64)


def transformed(text: str, h: list[int], cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """(n, form, prefix characters, middle characters, output) of a text under
    four hash values."""
    ends = unit_ends(text)
    n = len(ends)
    if not n or h[2] % 100 >= cut_percent or any(m in text for m in MARKS):
        return n, PLAIN, None, None, text
    cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    units = BoundarySet(ends)
    a, b = (units.select(k - 1) if k else 0 for k in cuts)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, SPM, a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, PSM, a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def hashes(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of sha256(seed:id), as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = 1, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``
    (null if plain) and ``output`` of every document."""
    ship_package(docs.sparkSession)
    src = docs.select(*(h.alias(f"__h{k}") for k, h in enumerate(hashes(F.col("doc_id"), seed))), F.col("text").alias("__text"), *keep)
    schema = docs.select(*keep).schema
    for name, kind in (("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for part in pieces_of(batch, "__text"):
                h = zip(*(part.column(k).to_pylist() for k in range(4)), strict=True)
                texts = part.column("__text").to_pylist()
                found = [transformed(t or "", x, cut_percent, spm_percent) for t, x in zip(texts, h, strict=True)]
                cols = [part.column(5 + i).cast(target.field(i).type) for i in range(len(keep))]
                cols += [pa.array(c, target.field(len(keep) + i).type) for i, c in enumerate(zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(cols, schema=target)

    return src.mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text an output was made from; the marks are found, not remembered."""
    at = {m: F.locate(m, output) for m in MARKS}
    size = len(PREFIX)

    def between(a: Column, b: Column) -> Column:
        return F.substring(output, a + size, b - a - size)

    middle = F.substring(output, at[MIDDLE] + size, F.length(output))
    psm = F.concat(between(at[PREFIX], at[SUFFIX]), middle, between(at[SUFFIX], at[MIDDLE]))
    spm = F.concat(between(at[PREFIX], at[MIDDLE]), middle, between(at[SUFFIX], at[PREFIX]))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
