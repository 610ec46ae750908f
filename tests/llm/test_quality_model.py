import numpy as np

from proselab.llm import quality_model as M

from .helpers import awkward_rows, frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from proselab.llm.queries import QUERIES

    out = QUERIES["op6_quality_model"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()


def test_awkward_rows(spark):
    rows = awkward_rows()
    docs = frame(spark, rows)
    none = M.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in M.score(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i, _ in rows if i is not None] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = M.score(docs, M.fit(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert M.score(frame(spark, []), none).collect() == []


def test_pooling_and_context_match_loops():
    texts = ["one two two one", "", "THE the, the"]
    b, n = M.tokens(texts)
    assert n.tolist() == [4, 0, 4] and b[2] == M.AGAIN and b[4] != b[5] and b[7] == M.AGAIN
    v = M.index_vectors()
    pooled = M.pooled(b, n, v)
    np.testing.assert_allclose(pooled[0, : M.DIMS], v[b[:4]].mean(axis=0), atol=1e-6)
    np.testing.assert_allclose(pooled[2, M.DIMS :], v[b[4:]].std(axis=0), atol=1e-5)
    assert not pooled[1].any()
    want = np.zeros_like(v)
    for a, z in ((0, 4), (4, 8)):
        for i in range(a, z):
            for j in range(max(a, i - M.REACH), min(z, i + M.REACH + 1)):
                if i != j:
                    want[b[i]] += v[b[j]]
    np.testing.assert_allclose(M.context_sums(b, n), want, atol=1e-5)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 2 * M.DIMS)).astype(np.float32)
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    m = M.train(x, y, M.index_vectors())
    s = M.score_pooled(x[::5], m)
    raw = M.score_pooled(x[::5], m._replace(temperature=1.0))

    def loss(p):
        return -np.mean(np.log(np.where(y[::5] > 0, p, 1 - p) + 1e-12))

    assert loss(s) <= loss(raw) + 1e-9


def test_rows_for_the_driver_do_not_grow_with_tasks(spark):
    rows = [(i, f"one two three word{i % 40} four") for i in range(400)]
    few, many = (M._bucket_sums(frame(spark, rows).repartition(n)).collect() for n in (1, 60))
    assert len(few) == len(many) == len({r["bucket"] for r in many}) <= M.BUCKETS
    want = M.context_sums(*M.tokens([t for _, t in rows]))
    for got in (few, many):
        for r in got:
            np.testing.assert_allclose(np.frombuffer(r["sums"], np.float32), want[r["bucket"]], atol=1e-3)
