import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from proselab.llm import byte_bpe as B

from .helpers import awkward_rows, frame

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def lib():
    with open(public_tokenizers.path(NAME), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_awkward_rows(spark, lib):
    rows = awkward_rows()
    have = sorted(map(tuple, B.digests(frame(spark, rows), NAME).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert have == sorted(want, key=repr)
    assert B.digests(frame(spark, []), NAME).collect() == []
    r = B.round_trip(frame(spark, [(1, "Grüße, 日本")]), NAME).first()
    assert r["ids"] == lib.encode_ordinary("Grüße, 日本") and bytes(r["decoded"]).decode() == "Grüße, 日本"


def test_random_strings(lib):
    rng = random.Random(9)
    letters = " \n\t.,'sSé́İß1²½\x1c\x85\xa0　日a'BΣ!"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += [c * n for c in ("a", "ab", " ", "é", "!") for n in (31, 32, 33, 63, 64, 65, 3000)]
    for t, ids in zip(texts, B.encode_texts(texts, NAME), strict=True):
        assert ids.tolist() == lib.encode_ordinary(t)
        assert B.decode(ids.tolist(), B.load(NAME)) == t.encode()


def test_rows_and_long_pieces_agree():
    rng = random.Random(2)
    r = B.load(NAME)
    pieces = [bytes(rng.choice(b"abcdeehinorst") for _ in range(rng.randint(2, 64))) for _ in range(300)]
    assert B.merge_rows(r, pieces, 64) == [B.merge_long(r, p) for p in pieces]


def test_a_full_cache_still_encodes_in_one_batch(monkeypatch, lib):
    from proselab.llm import vocab

    monkeypatch.setattr(vocab, "CACHE_ENTRIES", 10)
    cache, calls = B.rank_cache(NAME, None), []
    encode = cache.encode
    monkeypatch.setattr(cache, "encode", lambda parts: calls.append(len(parts)) or encode(parts))
    for k in range(3):
        texts = [" ".join(f"word{k}x{i}y" for i in range(100))]
        assert B.encode_texts(texts, NAME)[0].tolist() == lib.encode_ordinary(texts[0])
    assert len(calls) == 3
