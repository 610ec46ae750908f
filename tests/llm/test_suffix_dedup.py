import hashlib
import random

import numpy as np
import pytest

from proselab.llm import suffix_dedup as S

from .helpers import awkward_rows, frame

BIG = 1 << 62


def brute(rows):
    """(id, text) -> id, n_bytes, n_removed, n_spans, kept bytes."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - S.LENGTH + 1):
            w = b[s : s + S.LENGTH]
            first[w] = min(first.get(w, BIG), BIG if i is None else i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - S.LENGTH + 1):
            if first[b[s : s + S.LENGTH]] < (BIG if i is None else i):
                gone[s : s + S.LENGTH] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, kept))
    return out


def got(df):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes")
    return [tuple(bytes(r[c]) if c == "kept_bytes" else r[c] for c in cols) for r in df.collect()]


def test_awkward_rows(spark):
    rows = awkward_rows()
    assert sorted(got(S.dedup(frame(spark, rows))), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("letters,length", [("ab", 120), ("abcdefghij", 400), ("é日a", 200)])
def test_random_copies(spark, letters, length):
    rng = random.Random(len(letters))
    pool = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, length - 1)
            parts += [p[a : a + rng.randint(1, length)], "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))]
        rows.append((rng.randint(0, 40), "".join(parts)))
    assert sorted(got(S.dedup(frame(spark, rows))), key=repr) == sorted(brute(rows), key=repr)


def hot_rows():
    """A short string in most documents, in ever other surroundings, some of
    which recur."""
    rng = random.Random(8)
    around = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(40)]
    core = "the same thirty-four bytes, always"
    rows = [(rng.randint(0, 150), rng.choice(around)[rng.randint(0, 59) :] + core + rng.choice(around)[: rng.randint(0, 60)]) for _ in range(250)]
    return rows + [(None, core * 3), (7, core * 5), (7, core * 4), (400, core + "x" * 90 + core)]


@pytest.mark.parametrize("hot", [0, 20, 1 << 14])
def test_hot_anchors_equal_brute_force(spark, hot):
    rows = hot_rows()
    assert sorted(got(S.dedup(frame(spark, rows), hot_contexts=hot)), key=repr) == sorted(brute(rows), key=repr)


def test_no_task_sorts_a_hot_family():
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    bound, n_buckets = 64, 4
    rows = sorted((BIG if i is None else i, t) for i, t in hot_rows())
    groups = [pa.table({"__id": pa.array([i for i, _ in rows[k::5]], pa.int64()), "__text": [t for _, t in rows[k::5]], "__grp": pa.array([k] * len(rows[k::5]), pa.int32())}) for k in range(5)]
    hashes = pa.concat_tables([S._report(n_buckets)(t) for t in groups])
    by = lambda t, c, k: t.filter(pa.compute.equal(t.column(c), k))
    shared = pa.concat_tables([S._answer(bound)(by(hashes, "bucket", b)) for b in range(n_buckets) if by(hashes, "bucket", b).num_rows])
    sent = pa.concat_tables([S._send(n_buckets)(t, by(shared, "grp", k)) for k, t in enumerate(groups)])
    contexts = b"".join(pa.decompress(c, len(n) * S.WIDTH, codec="zstd", asbytes=True) for c, n, k in zip(*(sent.column(x).to_pylist() for x in ("context", "left", "kind")), strict=True) if k == S.SORTED)
    anchors = np.frombuffer(contexts, np.uint8).reshape(-1, S.WIDTH)[:, S.LEFT : S.LEFT + S.GRAM]
    assert np.unique(anchors, axis=0, return_counts=True)[1].max(initial=0) <= bound
    assert S.STRINGS in sent.column("kind").to_pylist()


def test_empty_table_and_text_output(spark):
    empty = frame(spark, [])
    assert S.dedup(empty).collect() == []
    rows = [(1, "ü" * 60), (2, "a" + "ü" * 40 + "b")]
    texts = {r["doc_id"]: r["kept_text"] for r in S.dedup(frame(spark, rows), as_text=True).collect()}
    assert texts == {1: "ü" * 60, 2: "ab"}


def test_sort_matches_bytes_and_survives_collisions(monkeypatch):
    rng = np.random.default_rng(3)
    chars = rng.integers(0, 2, (300, 12)).astype(np.uint8)
    size = rng.integers(0, 13, 300)
    chars[np.arange(12) >= size[:, None]] = 0
    family = np.sort(rng.integers(0, 7, 300))
    strings = [(int(f), bytes(c[:s])) for f, c, s in zip(family, chars, size, strict=True)]

    def check():
        order, common = S.Suffixes(chars, size).sort(family)
        ranked = [strings[i] for i in order]
        assert ranked == sorted(strings)
        for k in range(1, 300):
            (f, x), (g, y) = ranked[k - 1], ranked[k]
            lcp = next((j for j, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
            assert common[k] == (lcp if f == g else -1)

    check()
    # every hash alike: the bytes decide
    monkeypatch.setattr(S, "_letters", lambda: np.zeros(256, np.uint64))
    check()


def test_digest_of_query(spark, tmp_path):
    from proselab.llm.queries import QUERIES

    rows = awkward_rows(4)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op1_suffix_dedup"](spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(rows)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_buckets_are_even():
    """Anchors are least hashes, so their high bits alone would fill the first bucket."""
    rng = np.random.default_rng(0)
    least = rng.integers(0, 1 << 63, (60_000, 31), dtype=np.uint64).min(axis=1) * np.uint64(2)
    for n in (24, 122):
        share = np.bincount(S._buckets(least, n), minlength=n) / len(least) * n
        assert share.max() < 1.3 and share.min() > 0.7
