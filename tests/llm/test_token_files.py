import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from proselab.llm import token_files as T

from .helpers import awkward_rows, frame

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(public_tokenizers.path(NAME))
    t.encode_special_tokens = True
    return t


def test_awkward_rows(spark, tmp_path, tok):
    rows = awkward_rows()
    folder = f"{tmp_path}/files"
    manifest = T.write_token_files(frame(spark, rows), folder, NAME, end_id=1).collect()
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in ordered:
        x = np.array(ids[t], "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, T.read_token_files(spark, folder).collect()), key=repr) == sorted(want, key=repr)
    # the flat files, in order of their bases, are the concatenation
    flat = []
    for m in sorted(manifest, key=lambda m: m["base"]):
        assert m["base"] == len(flat)
        offsets, _ = T.read_index(folder, m["file"])
        assert offsets.dtype == np.dtype("<i8") and offsets[-1] == m["n_tokens"]
        flat += np.fromfile(f"{folder}/{m['file']}.bin", "<u2").tolist()
    assert flat == [x for _, t in ordered for x in ids[t]]


def test_empty_table_and_wide_ids(spark, tmp_path):
    T.write_token_files(frame(spark, []), f"{tmp_path}/none", NAME, end_id=1)
    assert T.read_token_files(spark, f"{tmp_path}/none").collect() == []
    T.write_token_files(frame(spark, [(1, "a b")]), f"{tmp_path}/wide", NAME, end_id=70000, width=4)
    assert T.read_token_files(spark, f"{tmp_path}/wide").first()["n_tokens"] == 3


def test_segment_cache_equals_the_library(tok):
    import random

    from proselab.llm.vocab import library_cache

    rng = random.Random(3)
    letters = " \n\t.,'sSé́İß1²½\x1c\x85\xa0　日a'BΣ!"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for name in (NAME, "byte_bpe_50k.json"):
        lib = Tokenizer.from_file(public_tokenizers.path(name))
        lib.encode_special_tokens = True
        for a, b in zip(lib.encode_batch(texts, add_special_tokens=False), library_cache(name).of(texts), strict=True):
            assert a.ids == np.frombuffer(b, "<u4").tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens_in_texts_as_the_library_has_them(name):
    from proselab.llm.vocab import library_cache

    lib = Tokenizer.from_file(public_tokenizers.path(name))  # default settings
    rng = np.random.default_rng(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "word", "Ünder", "a.b", "\u3000", "e\u0301", "'s", "7"]
    texts = ["<|endoftext|>", "the <|endoftext|> mark", "<|startoftext|>a  <|endoftext|><|endoftext|>  b"]
    texts += ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(3000)]
    for text, got in zip(texts, library_cache(name).of(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text
