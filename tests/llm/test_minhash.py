import random
import re

import numpy as np
import pytest

from proselab.llm import minhash as M
from proselab.llm.graph import components

from .helpers import BLANKS, awkward_rows, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, k):
    w = re.findall(BLANKS, (t or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, s in sets:
        c = None if i is None else root(i)
        out.append((i, len(s), c, i is not None and c == i))
    return out


@pytest.mark.parametrize("k,percent", [(2, 80), (5, 80)])
def test_awkward_rows(spark, k, percent):
    rng = random.Random(8)
    rows = awkward_rows()
    # a chain: neighbours are alike, the ends are not; and a hot group
    words = [f"w{i}" for i in range(60)]
    for j in range(6):
        rows.append((5000 - j, " ".join(words[3 * j :] + [f"z{i}" for i in range(3 * j)])))
    for j in range(40):
        w = list(words)
        w[rng.randrange(60)] = f"edit{j}"
        rows.append((6000 + j, " ".join(w).upper() if j % 2 else "  ".join(w)))
    have = sorted(map(tuple, M.near_duplicates(frame(spark, rows), k, percent).collect()), key=repr)
    assert have == sorted(brute(rows, k, percent), key=repr)


def test_empty_table(spark):
    assert M.near_duplicates(frame(spark, []), 2, 80).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = np.unique(np.r_[both, rng.integers(0, 1 << 63, 200, dtype=np.uint64)]), np.unique(both)
    est = (M.signature(a) == M.signature(b)).mean()
    assert abs(est - 0.8) < 0.12
    # one permutation, shifted: coordinate k is a minimum over places k further on
    ranks = M.circle()[:, 0]
    at = M.place(a).astype(np.int64)
    assert M.signature(a)[17] == min(ranks[(p + 17) % M.CIRCLE] for p in at)


def test_hashed_sets_count_shingles():
    texts = ["a b a b a b", "", "Word", "one Two\tthree", "x" * 5000 + " y"]
    assert [len(h) for h in M.hashed_sets(texts, 2)] == [len(shingles(t, 2)) for t in texts]
    assert len({M.hashed_sets([t], 2)[0].tobytes() for t in ("a b c", "A B C", " a\nb  c")}) == 1


def test_components_of_a_long_path(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 10 + n)] + [(5, 5), (900, 901), (901, 900)], "a long, b long")
    have = {r["id"]: r["component"] for r in components(edges).collect()}
    assert have == {i: 10 for i in range(10, 11 + n)} | {900: 900, 901: 900}
