import numpy as np
from pyspark.sql import functions as F

from proselab.llm import langid as L

from .helpers import awkward_rows, frame

SF = "/root/testdata/sf0.01"


def segmentations(word, t, p):
    """Sum over all ways to cut a word, by recursion."""
    full = L.START + word

    def go(i):
        if i == len(full):
            return 1.0
        total, node = 0.0, 1
        for j in range(i, min(i + L.LONGEST, len(full))):
            node = t.step[node, t.klass[ord(full[j])]]
            if not node:
                break
            total += p[node] * go(j + 1)
        return total

    return go(0)


def test_forward_sums_all_segmentations():
    t = L.trie()
    rng = np.random.default_rng(0)
    p = rng.random((len(t.is_piece), 2)) * t.is_piece[:, None]
    p /= p.sum(axis=0)
    words = ["the", "garden", "straße", "a", "ж日本", "internationally"]
    for take, table, size in L._tables(words, t.klass):
        got = L.forward(table, size, t.step, p)
        for i, row in zip(take, got, strict=True):
            np.testing.assert_allclose(row, [np.log(segmentations(words[i], t, p[:, k])) for k in range(2)], rtol=1e-9)
    # expected counts are the gradient of the log-likelihood
    q = p[:, 0].copy()
    (take, table, size), = L._tables(["garden", "the"], t.klass)
    counts = L.expected(table, size, np.ones(2), t.step, q)
    node = t.step[1, t.klass[ord("e")]]
    up, down = q.copy(), q.copy()
    up[node] *= 1 + 1e-6
    down[node] *= 1 - 1e-6
    slope = (L.forward(table, size, t.step, up[:, None]).sum() - L.forward(table, size, t.step, down[:, None]).sum()) / 2e-6
    np.testing.assert_allclose(counts[node], slope, rtol=1e-4)


def test_long_words_do_not_underflow():
    t = L.trie()
    p = (t.is_piece / t.is_piece.sum())[:, None]
    ll, n = L.log_likelihoods(["ab" * 20000, "1 2 3"], p, t)
    assert np.isfinite(ll[0, 0]) and n.tolist() == [1, 0]


def test_every_alphabetic_piece_counts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=L.vocabulary_path(L.VOCABULARY))
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    pieces = [p for p in pieces if p.removeprefix(L.START).isalpha()]
    assert len(pieces) > 23_000 and max(map(len, pieces)) == L.LONGEST
    t, seen = L.trie(), set()
    for p in pieces:
        node = 1
        for c in p:
            node = int(t.step[node, t.klass[ord(c)]])
        assert node and t.is_piece[node]
        seen.add(node)
    assert len(seen) == len(pieces)
    # letters of their own where a piece holds them, else one class a block
    assert len({int(t.klass[ord(c)]) for c in "абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґ"}) == 36
    assert t.klass[0x13A0] == t.klass[0x13A1] != t.klass[0x13A0 + 64 * 128]
    for c in map(chr, range(0x110000)):
        if L.LETTERS.fullmatch(c):
            assert t.step[1, t.klass[ord(c)]]


def test_languages_of_one_script(spark):
    rows = [
        (1, "Он сказал, что это был новый дом и что он будет жить в этом городе", "ru"),
        (2, "Він сказав, що це був новий дім і що він буде жити в цьому місті", "uk"),
        (3, "Той каза, че това е нова къща и че ще живее в този град", "bg"),
    ]
    schema = "doc_id long, text string, lang string"
    model = L.fit(spark.createDataFrame(rows, schema))
    docs = spark.createDataFrame([(10, "это новый город, он был", ""), (11, "це новий дім, що був у місті", ""), (12, "това е град, в този живее", "")], schema)
    assert {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, model).collect()} == {10: "ru", 11: "uk", 12: "bg"}


def test_expected_counts_of_long_words():
    t = L.trie()
    p = t.is_piece / t.is_piece.sum()
    # words too long for plain products of probabilities, beside short ones
    for word in ("a" * 3000, "ж" * 200, "internationally" * 40):
        for take, table, size in L._tables([word, "the", "garden"], t.klass):
            counts = L.expected(table, size, np.ones(len(take)), t.step, p)
            assert np.isfinite(counts).all() and counts.sum() >= 3
    # every letter and the start mark are covered exactly once
    depth = np.zeros(len(p))
    for node in range(1, len(p)):
        nxt = t.step[np.full(int(t.klass.max()) + 1, node), np.arange(int(t.klass.max()) + 1)]
        depth[nxt[nxt > 0]] = depth[node] + 1
    for word in ("a" * 3000, "ж" * 200, "internationally" * 40, "the"):
        (_, table, size), = L._tables([word], t.klass)
        counts = L.expected(table, size, np.ones(1), t.step, p)
        np.testing.assert_allclose((counts * depth).sum(), len(word) + 1, rtol=1e-9)


def test_long_runs_in_training_change_no_prediction(spark):
    rows = [(1, "le jardin de la maison et la rue", "fr"), (2, "the garden of the house and the road", "en")]
    odd = [(3, "the " + "a" * 3000, "en"), (4, "la " + "ж" * 200, "fr")]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(10, "the house of the garden", ""), (11, "la maison de la rue", "")], schema)
    said = []
    for more in ([], odd):
        model = L.fit(spark.createDataFrame(rows + more, schema))
        assert np.isfinite(model[1]).all() and (model[1].sum(axis=0) > 0.999).all()
        out = L.predict(docs, model).collect()
        assert all(np.isfinite(r["score"]) for r in out)
        said.append({r["doc_id"]: r["lang_pred"] for r in out})
    assert said[0] == said[1] == {10: "en", 11: "fr"}


def test_held_out_accuracy(spark):
    from proselab.llm.queries import QUERIES

    out = QUERIES["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_awkward_rows(spark):
    rows = awkward_rows()
    docs = frame(spark, rows)
    nothing = L.fit(docs.filter(F.lit(False)))
    assert {(r["lang_pred"], r["score"]) for r in L.predict(docs, nothing).collect()} == {(L.UNKNOWN, 0.0)}
    french = spark.createDataFrame([(1, "le jardin de la maison", "fr"), (2, "the garden of the house", "en"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = L.fit(french)
    assert model[0] == ["en", "fr"]
    out = {(r["doc_id"], r["lang_pred"]) for r in L.predict(docs, model).collect()}
    unknown = {i for i, p in out if p == L.UNKNOWN}
    assert {i for i, t in rows if not any(c.isalpha() for c in t or "")} == unknown
    assert L.predict(frame(spark, []), model).collect() == []
    same = L.predict(docs, model, tuple(docs.columns[:5]))
    assert same.columns == [*docs.columns[:5], "lang_pred", "score"]
