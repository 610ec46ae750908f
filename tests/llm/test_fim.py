import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proselab.llm import fim as M

from .helpers import awkward_rows, frame

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 5 << 16), max_size=300), st.lists(st.tuples(st.integers(0, 5 << 16), st.integers(1, 9000)), max_size=6))
def test_select_is_the_sorted_list(points, runs):
    values = set(points)
    for a, n in runs:
        values |= set(range(a, a + n, 1 + a % 3))  # runs, and dense but broken stretches
    values = np.array(sorted(values), np.int64)
    units = M.BoundarySet(values)
    assert len(units) == len(values)
    for k in {0, len(values) // 3, len(values) // 2, len(values) - 1, *range(0, len(values), 997)}:
        if 0 <= k < len(values):
            assert units.select(k) == values[k]


def test_every_kind_of_container():
    rng = np.random.default_rng(4)
    sparse = np.sort(rng.choice(65536, 3000, replace=False))
    dense = np.sort(rng.choice(65536, 30000, replace=False))
    kinds = [type(M.container(v)) for v in (sparse, dense, np.arange(65536), np.arange(0, 65536, 2))]
    assert kinds == [M.ArrayContainer, M.BitmapContainer, M.RunContainer, M.BitmapContainer]
    for v in (sparse, dense, np.arange(65536), np.arange(0, 65536, 2)):
        c = M.container(v)
        assert all(c.select(k) == v[k] for k in range(0, len(v), 61)) and c.select(len(v) - 1) == v[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ @[`{é½日\n\x00😀K"), st.characters(codec="utf-8")), max_size=60))
def test_units_match_the_pattern(text):
    want = np.cumsum([len(u) for u in UNIT.findall(text)])
    assert M.unit_ends(text).tolist() == list(map(int, want))


def brute(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = UNIT.findall(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm = h[3] % 100 < 20
    return doc_id, len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def extra_rows():
    rng = random.Random(8)
    odd = ["<", "<P", "<P>", "a<S>b", "ends with <", "P> < S>", "<<M", "İIK", "\U0001f600" * 9, "a" * 70_000, "ab, " * 40_000]
    rows = [(1000 + i, t) for i, t in enumerate(odd * 6)]
    return rows + [(2000 + i, "".join(rng.choice("<PSM>ab é") for _ in range(rng.randint(0, 40)))) for i in range(300)]


def test_matches_brute_force_on_awkward_rows(spark):
    rows = awkward_rows() + extra_rows()
    out = M.fill_in_middle(frame(spark, rows))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = out.withColumn("again", M.restored(F.col("form"), F.col("output"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in out))) == sorted(repr(brute(*r)) for r in rows)
    want = sorted(repr((i, t or "")) for i, t in rows)
    assert sorted(repr((r["doc_id"], r["again"])) for r in out) == want
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(frame(spark, [])).collect() == []


def test_parameters(spark):
    df = frame(spark, [(i, "one two three four") for i in range(200)])
    forms = [r["form"] for r in M.fill_in_middle(df, seed=7, cut_percent=100, spm_percent=100, keep=("doc_id", "pid")).collect()]
    assert set(forms) == {"spm"}
    assert {r["form"] for r in M.fill_in_middle(df, cut_percent=0).collect()} == {"plain"}


@pytest.mark.parametrize("n", [3, 400_000])
def test_long_text(n):
    text = "word, " * n  # up to 2.4 MB
    got = M.transformed(text, [n, 3 * n, 0, 99])
    a, b = sorted((n % (3 * n + 1), 3 * n % (3 * n + 1)))
    u = UNIT.findall(text)
    assert got[:2] == (3 * n, "psm") and got[2] == len("".join(u[:a])) and got[3] == len("".join(u[a:b]))


def test_query_matches_its_sql(spark):
    import duckdb

    from proselab.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(ORACLES["op12_fill_in_middle"]).fetchall()
    assert sorted(map(tuple, QUERIES["op12_fill_in_middle"](spark, sf).collect())) == sorted(want)
