import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from proselab.llm import packing as P

from .helpers import awkward_rows, frame

NAME = "byte_bpe_50k.json"


def bins_of(counts, capacity):
    runs = P.plan(counts, capacity)
    used, bins = defaultdict(int), defaultdict(list)
    for s, k, first, offset in runs:
        used[s] += k
        for i in range(k):
            bins[first + i].append((offset, s))
    assert dict(used) == {s: c for s, c in counts.items() if c}
    for items in bins.values():
        at = 0
        for offset, s in sorted(items):
            assert offset == at
            at += s
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def optimum(items, capacity):
    best, items = len(items), sorted(items, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_plans_are_valid_and_near_the_optimum():
    rng, worse = random.Random(0), 0
    for _ in range(400):
        capacity = rng.randint(5, 30)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        n, best = bins_of(counts, capacity), optimum(items, capacity) if items else 0
        assert n >= best
        worse += n > best
    assert worse <= 4
    assert bins_of({}, 2048) == 0
    assert bins_of({700: 1001}, 2048) == 501
    rng = np.random.default_rng(0)
    sizes, n = np.unique(np.clip(rng.lognormal(6, 1.2, 200_000).astype(int), 1, 2048), return_counts=True)
    low = -(-int((sizes * n).sum()) // 2048)
    assert bins_of(dict(zip(sizes.tolist(), n.tolist(), strict=True)), 2048) <= 1.001 * low + 1


def test_awkward_rows(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(NAME))
    tok.encode_special_tokens = True
    rows = awkward_rows()
    capacity = 64
    out = [r.asDict() for r in P.pack(frame(spark, rows), NAME, 0, capacity).collect()]
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    have = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) <= 1.1 * sum(r["length"] for r in out) / capacity + 1
    assert P.pack(frame(spark, []), NAME, 0).collect() == []


def test_packing_starts_without_the_tables_of_earlier_operators():
    """Python workers outlive their stages: what langid, minhash and
    suffix_dedup keep in them is not packing's to carry."""
    from proselab.llm import minhash, suffix_dedup, vocab

    minhash.circle()
    suffix_dedup._kept_powers()
    vocab.release()
    assert minhash.circle.cache_info().currsize == suffix_dedup._kept_powers.cache_info().currsize == 0
