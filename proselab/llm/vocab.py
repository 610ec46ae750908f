"""Segment caches over the public tokenizers.

Text is cut at white space first.  A segment's ids do not depend on what
stands beside it, because no pre-token of the patterns used here crosses the
cut, so a worker encodes every distinct segment once and joins the cached ids.
Before that, a library's texts are cut at its special tokens, which have ids of
their own.
"""

from __future__ import annotations

import array
import functools
import gc
import itertools
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..functions.arrow import trim_memory

#: Unicode White_Space, the set the tokenizers' patterns mean by ``\s``
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: as the byte-level pattern: a blank goes with the word after it
SPACED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: words between ASCII blanks
WORDS = re.compile(r"[^ \n\t\r]+")
#: letters, then marks: two pre-tokens under every pattern used here
LETTERS, MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", ".,;:!?"
PLAIN = re.compile(f"( ?[{LETTERS}]+)([{MARKS}]*)")
#: either of the two
PIECE = re.compile(f" ?[{LETTERS}]+|[{MARKS}]+")
#: cached segments a worker holds at most
CACHE_ENTRIES = 1_000_000
#: and characters of them, however long each is
CACHE_CHARS = 32 << 20


#: tables that operators keep in a worker from task to task
_KEPT: list = []


def kept(maxsize: int) -> Callable:
    """``lru_cache`` whose tables ``release`` drops."""

    def wrap(f: Callable) -> Callable:
        _KEPT.append(functools.lru_cache(maxsize=maxsize)(f))
        return _KEPT[-1]

    return wrap


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the package's."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """Byte -> printable code point of the byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class SegmentCache(dict):
    """segment -> ids as little-endian unsigned 32-bit bytes; ``special`` are
    the ids of tokens that no segment may hold."""

    def __init__(self, cut: re.Pattern, encode: Callable[[list[str]], list[list[int]]], special: dict[str, int] | None = None):
        super().__init__()
        self.cut, self.encode = cut, encode
        self.special = {t: array.array("I", [i]).tobytes() for t, i in (special or {}).items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.core: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        m = PLAIN.fullmatch(segment)
        parts = [x for x in m.groups() if x] if m else [segment]
        if new := [p for p in parts if p not in self.core]:
            self._learn(new)
        out = self[segment] = b"".join([self.core[p] for p in parts])
        return out

    def _learn(self, new: list[str]) -> None:
        for p, ids in zip(new, self.encode(new), strict=True):
            self.core[p] = array.array("I", ids).tobytes()

    def learn(self, segments: set[str]) -> None:
        """Encode all new parts of ``segments`` in one call."""
        new = set()
        for s in segments.difference(self):
            m = PLAIN.fullmatch(s)
            new.update(x for x in (m.groups() if m else (s,)) if x)
        if new := list(new.difference(self.core)):
            self._learn(new)

    def trim(self) -> None:
        """Forget everything when the cache is full."""
        if len(self) + len(self.core) > CACHE_ENTRIES:
            self.clear()
            self.core.clear()

    def of(self, texts: list[str]) -> list[bytes]:
        """ids of each text, as bytes; starts afresh when the cache is full."""
        self.trim()
        return self.join(texts)

    def join(self, texts: list[str]) -> list[bytes]:
        """The same without a look at the cache's size."""
        cut, get = self.cut.findall, self.__getitem__
        return [self._around(text) if any(t in text for t in self.special) else b"".join(map(get, cut(text))) for text in texts]

    def _around(self, text: str) -> bytes:
        """ids of a text that holds special tokens."""
        parts = self.at_special.split(text)
        parts[::2] = [b"".join(map(self.__getitem__, self.cut.findall(p))) for p in parts[::2]]
        parts[1::2] = [self.special[p] for p in parts[1::2]]
        return b"".join(parts)


class LibraryCache(SegmentCache):
    """Cache over a ``tokenizers`` library file.  A batch is cut at once; plain
    words and the marks behind them are pieces of their own and go straight to
    the library's BPE model, any other segment through its chain."""

    def __init__(self, tok, special: dict[str, int]):
        self.lower = tok.normalizer is not None
        super().__init__(WORDS if self.lower else SPACED, self._chain, special)
        self.tok, self.model, self.letters = tok, tok.model, byte_letters()
        self.chars = 0

    def _chain(self, parts: list[str]) -> list[list[int]]:
        return [self.tok.encode(p, add_special_tokens=False).ids for p in parts]

    def _words(self, parts: list[str]) -> list[list[int]]:
        if self.lower:
            parts = [p.lower() for p in parts]
        blank = chr(self.letters[32])
        spelled = [p.replace(" ", blank) if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in parts]
        return [[t.id for t in found] for found in map(self.model.tokenize, spelled)]

    def _keep(self, parts: list[str], ids: list[list[int]]) -> None:
        flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4").tobytes()
        a = 0
        for p, n in zip(parts, map(len, ids), strict=True):
            self[p] = flat[a : a + 4 * n]
            a += 4 * n

    def learn(self, segments: set[str]) -> None:
        match = PIECE.fullmatch
        new = list(segments.difference(self))
        self.chars += sum(map(len, new))
        plain = [bool(match(s)) for s in new]
        words = list(itertools.compress(new, plain))
        self._keep(words, self._words(words))
        other = [s for s, p in zip(new, plain, strict=True) if not p]
        self._keep(other, self._chain(other))

    def __missing__(self, segment: str) -> bytes:
        m = PLAIN.fullmatch(segment)
        if m and m[2]:
            return self[m[1]] + self[m[2]]
        self.learn({segment})
        return self[segment]

    def trim(self) -> None:
        if self.chars > CACHE_CHARS or len(self) > CACHE_ENTRIES:
            self.clear()
            self.chars = 0

    def of(self, texts: list[str]) -> list[bytes]:
        """ids of each text, as bytes.  All texts are cut at once and only
        their distinct segments become Python strings."""
        self.trim()
        whole = [not any(t in text for t in self.special) for text in texts]
        out = [b"" if w else self._around(text) for w, text in zip(whole, texts, strict=True)]
        mine = [text if w else "" for w, text in zip(whole, texts, strict=True)]
        ends = np.cumsum([len(t) for t in mine], dtype=np.int64)
        joined = "".join(mine)
        cuts, segments = _segments(joined, ends, spaced=not self.lower)
        if len(segments):
            found = segments.dictionary_encode()
            unique = found.dictionary.to_pylist()
            collects = gc.isenabled()
            gc.disable()  # many small lists, none of them in a cycle
            try:
                self.learn(set(unique))
            finally:
                if collects:
                    gc.enable()
            ids = pa.array([self[s] for s in unique], pa.large_binary()).take(found.indices)
            at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
            data, last = memoryview(ids.buffers()[2]), at[np.searchsorted(cuts, ends)].tolist()
            for i, (x, y) in enumerate(zip([0, *last], last)):  # noqa: B905
                if whole[i]:
                    out[i] = bytes(data[x:y])
        return out


def _segments(text: str, ends: np.ndarray, spaced: bool) -> tuple[np.ndarray, pa.Array]:
    """Starts (code points) and strings of the segments that ``SPACED`` or
    ``WORDS`` finds in each of the texts that end at ``ends``; ``PLAIN`` ones
    are cut again before their marks."""
    raw = text.encode()
    if len(raw) == len(text):
        c, at = np.frombuffer(raw, np.uint8), None
    else:
        c = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF).astype(np.int64))
    kind = _kinds(spaced)[np.minimum(c, WHITE_TOP + 1) if at is not None else c]
    white = kind == BLANK
    n = len(c)
    lead = np.zeros(n + 1, bool)  # the first character of a text
    lead[0], lead[ends] = True, True
    change = np.flatnonzero((white[1:] != white[:-1]) & ~lead[1:n]) + 1
    cut = lead[:n]
    if spaced:  # the last blank of a run stands alone, or with the word if it is a space
        word = change[~white[change]]
        cut[change[white[change]]] = True
        cut[word - 1] = True
        cut[word[c[word - 1] != 32]] = True
    else:
        cut[change] = True
    # a segment is plain if it begins with a letter, behind a space or not, and
    # holds letters, then marks
    starts = np.flatnonzero(cut)
    first = starts + (spaced & (c[starts] == 32) & (np.diff(np.r_[starts, n]) > 1)) if n else starts
    odd = np.zeros(n + 1, np.int32)
    odd[1:] = kind == OTHER
    odd[2:] += ((kind[1:] == LETTER) & (kind[:-1] == MARK) & ~cut[1:])
    np.cumsum(odd, out=odd)
    plain = (kind[first] == LETTER) & (odd[np.r_[starts[1:], n]] == odd[starts + 1] - (kind[starts] == OTHER)) if n else np.zeros(0, bool)
    tail = np.flatnonzero((kind[1:] == MARK) & (kind[:-1] == LETTER) & ~cut[1:]) + 1
    cut[tail[plain[np.searchsorted(starts, tail, side="right") - 1]]] = True
    starts = np.flatnonzero(cut)
    bounds = np.r_[starts, n]
    offsets = bounds if at is None else np.r_[0, at][bounds]
    buffers = [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw)]
    segments = pa.LargeStringArray.from_buffers(len(starts), buffers[1], buffers[2])
    if spaced:
        return starts, segments
    kept = ~white[starts]
    return starts[kept], segments.filter(pa.array(kept))


#: the last code point that is white space
WHITE_TOP = 0x3000


#: kinds of code points: plain letters and marks as in ``PLAIN``, blanks that cut
OTHER, LETTER, MARK, BLANK = range(4)


@functools.lru_cache(maxsize=2)
def _kinds(spaced: bool) -> np.ndarray:
    """The kind of each code point; one more entry stands for all above."""
    blank = re.compile(f"[{WHITE}]" if spaced else "[ \n\t\r]")
    letter, mark = re.compile(f"[{LETTERS}]"), re.compile(f"[{MARKS}]")
    out = np.zeros(WHITE_TOP + 2, np.uint8)
    for i in range(WHITE_TOP + 1):
        c = chr(i)
        out[i] = BLANK if blank.match(c) else LETTER if letter.match(c) else MARK if mark.match(c) else OTHER
    return out


@functools.lru_cache(maxsize=4)
def library_cache(name: str, folder: str | None = None) -> LibraryCache:
    """Cache over a ``tokenizers`` file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path(name, folder))
    tok.encode_special_tokens = True  # segments hold none; texts are cut at them first
    added = {i: t for i, t in tok.get_added_tokens_decoder().items() if t.special}
    if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
        raise ValueError(f"{name} has special tokens that are not matched as they stand")
    return LibraryCache(tok, {t.content: i for i, t in added.items()})


def forget() -> None:
    """Drop the segment caches.  Python workers outlive their stages; tasks of
    operators that encode nothing call this, so that the memory is theirs."""
    if library_cache.cache_info().currsize:
        library_cache.cache_clear()


def release() -> None:
    """Drop the tables of the operators that ran here before, and give their
    memory back; the segment caches stay."""
    for table in _KEPT:
        table.cache_clear()
    trim_memory()
