import math

import numpy as np
import pytest

from proselab.llm import whitening as W

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, key int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def spectrum(kind, d, rng):
    if kind == "plain":
        return rng.normal(size=(5 * d, d))
    if kind == "graded":
        return rng.normal(size=(5 * d, d)) * np.logspace(0, -7, d)
    if kind == "equal":  # every eigenvalue the same
        return np.vstack([np.eye(d), -np.eye(d)])
    if kind == "pairs":  # eigenvalues in equal pairs
        return np.vstack([np.diag(1 + np.arange(d) // 2.0), -np.diag(1 + np.arange(d) // 2.0)])
    if kind == "rank":  # half the directions hold nothing
        return rng.normal(size=(5 * d, d // 2)) @ rng.normal(size=(d // 2, d))
    return np.repeat(rng.normal(size=(5 * d, d // 2)), 2, axis=1)  # copies of columns


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "pairs", "rank", "copies"])
@pytest.mark.parametrize("d", [2, 7, 64])
def test_eigen_matches_brute_force(kind, d):
    x = spectrum(kind, d, np.random.default_rng(d))
    r = np.linalg.qr(x, mode="r")
    values, z = W.eigen(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    want = want[want > (d * W.EPS) ** 2 * want[0]] if kind != "rank" and kind != "copies" else want[: d // 2]
    values, z = (values, z) if kind not in ("rank", "copies") else (values[: d // 2], z[:, : d // 2])
    assert len(values) == len(want)
    np.testing.assert_allclose(values, want, rtol=1e-10)
    np.testing.assert_allclose(z.T @ z, np.eye(len(values)), atol=1e-11)
    np.testing.assert_allclose(r.T @ (r @ z), z * values, atol=1e-12 * want[0] * d)


def test_small_singular_values_are_accurate():
    """dqds keeps the relative accuracy that a covariance matrix loses."""
    q, e = np.logspace(0, -20, 12), np.logspace(-1, -22, 11)
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1)
    want = 1 / np.linalg.svd(np.linalg.inv(b), compute_uv=False)[::-1]  # exact enough for a graded triangle
    np.testing.assert_allclose(np.sqrt(W.dqds(q, e)), np.sort(want)[::-1], rtol=1e-8)
    assert W.dqds(np.array([4.0]), np.zeros(0)).tolist() == [4.0]
    np.testing.assert_allclose(W.dqds(np.array([1.0, 2.0, 3.0]), np.zeros(2)), [3, 2, 1])


def brute(rows):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = [int(sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True))) for r in x]
    c = np.array([[float((n * a - t)) / n for a, t in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    return dev, c, e[::-1], v[:, ::-1]


def test_query_matches_brute_force(spark):
    from proselab.llm.queries import QUERIES

    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table]
    dev, c, e, v = brute(rows)
    out = QUERIES["op11_embedding_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 32 * len(rows) and (out.n == len(rows)).all()
    assert out.deviation.to_numpy().reshape(-1, 32)[:, 0].tolist() == dev
    got = out.whitened.to_numpy().reshape(-1, 32)
    want = c @ v[:, :32] / np.sqrt(e[:32])
    sign = np.sign((got * want).sum(axis=0))
    np.testing.assert_allclose(got * sign, want, atol=1e-9)
    np.testing.assert_allclose(out.explained.to_numpy()[:32], e[:32] / e.sum(), rtol=1e-10)
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-10
    np.testing.assert_allclose(got.T @ got / len(got), np.eye(32), atol=1e-10)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    good += [good[0], good[0], (None, good[1][1]), (7, good[2][1])]  # repeats, no id, one id twice
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [math.inf] + [0.0] * 4), (105, [1e30] * 5), (106, [1.0, 2.0])]
    out = W.components(frame(spark, good + bad), W.fit(frame(spark, good + bad)))
    got = out.collect()
    dev, c, e, v = brute(good)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(dev)
    assert {r["n"] for r in got} == {len(good)} and {r["component"] for r in got} == set(range(1, 6))
    assert sum(r["vec_id"] is None for r in got) == 5 and not any((r["vec_id"] or 0) >= 100 for r in got)
    assert abs(sum({r["explained"] for r in got}) - 1) < 1e-12


def test_tables_without_components(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        df = frame(spark, rows)
        assert W.components(df, W.fit(df)).collect() == []


def test_deviation_beyond_64_bits_is_null():
    x = np.array([[1 << 40, 0], [0, 0]])
    low, rest = np.array([1 << 39, 0]), np.zeros(2, np.int64)
    assert W.deviations(x, low, rest, 2) == [None, None]
    assert W.deviations(x >> 20, low >> 20, rest, 2) == [1 << 40, 1 << 40]


def test_partitions_and_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = frame(spark, [(i, rng.normal(size=6).tolist()) for i in range(500)])
    a, b = W.fit(df.repartition(1)), W.fit(df.repartition(37))
    np.testing.assert_allclose(a.values, b.values, rtol=1e-12)
    assert a.n == b.n and (a.low == b.low).all() and (a.rest == b.rest).all()
