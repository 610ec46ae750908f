import itertools
import math
import random

import numpy as np

from proselab.llm import toxicity as T

from .helpers import awkward_rows, frame

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    from proselab.llm.queries import QUERIES

    out = QUERIES["op13_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.05
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()


def test_labels_of_held_out_documents_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from proselab.llm.common import held_out
    from pyspark.sql import functions as F

    hidden = held_out(F.col("doc_id"), 4, 2)
    flipped = labels.withColumn("toxic", F.when(hidden, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.fit(docs, x.filter(~hidden)) for x in (labels, flipped))
    assert a == b


def maximal(scores):
    """All maximal segments by their definition: the best segment of a range
    (leftmost, shortest), then the same on both sides of it."""
    out = []

    def cut(a, z):
        best = None
        for i, j in itertools.combinations(range(a, z + 1), 2):
            s = sum(scores[i:j])
            if s > 1e-9 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) <= 1e-9 and j - i < best[2] - best[1])):
                best = (s, i, j)
        if best:
            cut(a, best[1])
            out.append((best[0], best[1], best[2] - 1))
            cut(best[2], z)

    cut(0, len(scores))
    return out


def test_segments_match_their_definition():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(0, 14)
        scores = [rng.choice([-T.DRIFT] * 2 + [0.37, 1.13, 2.71, 5.9]) for _ in range(n)]
        scores = [s + rng.random() * 0.01 if s > 0 else s for s in scores]
        got = T.segments([(i, s) for i, s in enumerate(scores) if s > 0])
        want = maximal(scores)
        assert [(i, j) for _, i, j in got] == [(i, j) for _, i, j in want]
        np.testing.assert_allclose([s for s, _, _ in got], [s for s, _, _ in want])


def test_dirichlet_chain_and_floor():
    model = T.Model({"idio*": (8, 2), "idiots": (5, 0), "the": (10, 90)}, 0.1, 1.0, 0.01, 1.0, 0.0)
    scores = T.Scores(model)
    stem = (8 + 10 * 0.1) / 20
    word = (5 + 4 * stem) / 9

    def logit(p):
        return math.log(p / (1 - p))

    assert math.isclose(scores["idiots"], logit(word) - logit(0.1) - T.DRIFT)
    assert math.isclose(scores["idiotic"], logit(stem) - logit(0.1) - T.DRIFT)  # unseen: its stem
    assert scores["the"] == scores["unknown"] == -T.DRIFT
    assert scores["x" * 1000] == -T.DRIFT and "x" * 1000 not in scores


def test_lambda_and_curve():
    score, count = np.array([-2.0, 1.0]), np.array([90.0, 10.0])
    lam = T.solve_lambda(score, count)
    assert lam == 1.0  # no root below 1
    score = np.array([-2.0, 3.0])
    lam = T.solve_lambda(score, count)
    assert abs(0.9 * math.exp(-2 * lam) + 0.1 * math.exp(3 * lam) - 1) < 1e-6 and lam > 0.01
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, bias = T.logistic(x, y)
    assert abs(slope - 2) < 0.25 and abs(bias + 1) < 0.2
    assert T.logistic(-x, y)[0] == 0.0


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("river", "stone", "cloud", "wint", "gard") for b in ("s", "er", "ing", "ly", "ed", "ful")]
    bad = ["vilest", "wretched", "fiendish", "loathsome"]
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if i % 6 == 0:
            at = rng.randrange(len(ws))
            ws[at:at] = rng.sample(bad, 3)
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(i % 6 == 0)))
    return rows, labels


def test_passages_are_found_where_they_stand(spark):
    rows, labels = corpus()
    model = T.fit(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    text = "Rivers stoneer — cloudly " * 30 + "Wretched, vilest loathsome" + " clouds wintly" * 40
    long = "gardful stoneed " * 90_000 + "fiendish wretched vilest " + "rivers " * 20_000  # over 1 MB
    out = {r["doc_id"]: r for r in T.score(frame(spark, [(1, text), (2, long), (3, "rivers " * 500), (4, None)]), model).collect()}
    assert [text[p["start"] : p["end"]] for p in out[1]["passages"]] == ["Wretched, vilest loathsome"]
    assert [long[p["start"] : p["end"]] for p in out[2]["passages"]] == ["fiendish wretched vilest"]
    assert all(p["expected"] <= T.SIGNIFICANT for r in out.values() for p in r["passages"])
    assert [out[i]["predicted"] for i in (1, 2, 3, 4)] == [1, 1, 0, 0] and out[3]["passages"] == out[4]["passages"] == []


def test_awkward_rows(spark):
    rows = awkward_rows()
    docs = frame(spark, rows)
    assert {r["score"] for r in T.score(docs, T.fit(docs, spark.createDataFrame([], LABELS))).collect()} == {0.0}
    ids = sorted({i for i, _ in rows if i is not None})
    one = T.fit(docs, spark.createDataFrame([(i, 1, 1) for i in ids], LABELS))
    assert {r["score"] for r in T.score(docs, one).collect()} == {1.0}
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in ids] + [(ids[0], 1, 1), (ids[1], 1, None), (None, 1, 1)], LABELS)
    model = T.fit(docs, labels)
    out = T.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert T.score(frame(spark, []), model).collect() == []
    assert T.fit(frame(spark, []), labels).constant == 0.0


def test_table_of_words_is_bounded(spark):
    rows, labels = corpus()
    model = T.fit(frame(spark, rows), spark.createDataFrame(labels, LABELS), nodes=5)
    assert len(model.nodes) == 5
