import itertools
import re

import numpy as np

from proselab.llm import quality_rules as Q

from .helpers import BLANKS, awkward_rows, frame


def base(t):
    t = t or ""
    w = re.findall(BLANKS, t)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    cover = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(BLANKS, line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n


def test_counts_on_awkward_rows(spark):
    rows = awkward_rows() + [(900, "a b\n\na b\n a b\r\na b\n\x0b\n"), (901, "# * | <>\n" * 40), (902, "\n".join(["one two three four five six"] * 3))]
    out = Q.judge(frame(spark, rows), Q.PRIOR).collect()
    have = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out]
    assert sorted(have, key=repr) == sorted([(i, *base(t)) for i, t in rows], key=repr)
    assert all(not (r["base_failed"] and r["kept"]) for r in out)
    assert Q.judge(frame(spark, []), Q.PRIOR).collect() == []


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(0)
    doc = np.repeat(np.arange(5), [1, 6, 3, 4, 2])
    x = rng.normal(size=(len(doc), 3))
    field = Q.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    got = Q.viterbi(x, doc, field)
    for d in range(5):
        at = np.flatnonzero(doc == d)

        def value(y, at=at):
            return sum(x[i] @ field.weight * k for i, k in zip(at, y, strict=True)) + sum(field.step[a, b] for a, b in itertools.pairwise(y))

        assert tuple(got[at]) == max(itertools.product((0, 1), repeat=len(at)), key=value)


def test_training_raises_the_likelihood_and_separates():
    rng = np.random.default_rng(1)
    doc = np.repeat(np.arange(60), 5)
    label = np.repeat(rng.integers(0, 2, 60), 5)
    x = np.stack([np.ones(300), label + rng.normal(0, 0.7, 300)], axis=1)
    field = Q.train(x, doc, label)
    assert (Q.viterbi(x, doc, field) == label).mean() > 0.95
    assert field.step[0, 0] > field.step[0, 1]
    assert Q.train(x, doc, np.zeros(300, int)) is Q.PRIOR


def test_clean_documents_stay_and_junk_goes(spark):
    from proselab.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    out = QUERIES["op3_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good = out[(out.quality == 1) & ~out.base_failed]
    assert good.kept.mean() > 0.98
    assert (~out[out.quality == 0].kept).mean() > 0.9


def test_fit_without_labels(spark):
    docs = frame(spark, awkward_rows())
    assert Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is Q.PRIOR


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(4), [1, 5, 3, 4])
    x, w, t, hint = rng.normal(size=(len(doc), 3)), rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=len(doc))
    post, pairs = Q.marginals(x, Q._steps(doc), w, t, hint)
    want, want_pairs = np.zeros(len(doc)), np.zeros((2, 2))
    for d in range(4):
        at = np.flatnonzero(doc == d)
        all_y = list(itertools.product((0, 1), repeat=len(at)))
        p = np.array([np.exp(sum((x[i] @ w + hint[i]) * k for i, k in zip(at, y, strict=True)) + sum(t[a, b] for a, b in itertools.pairwise(y))) for y in all_y])
        for y, share in zip(all_y, p / p.sum(), strict=True):
            want[at] += share * np.array(y)
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += share
    assert np.allclose(post, want)
    assert np.allclose(pairs, want_pairs)


def test_latent_labels_differ_from_the_documents():
    """One line in five of either kind of document is of the other kind."""
    rng = np.random.default_rng(4)
    doc, kind = np.repeat(np.arange(200), 10), np.repeat(rng.integers(0, 2, 200), 10)
    line = np.where(np.tile(np.arange(10) < 2, 200), 1 - kind, kind)
    x = np.stack([np.ones(2000), line + rng.normal(0, 0.15, 2000)], axis=1)
    field = Q.train(x, doc, kind, evidence=Q.EVIDENCE, cap=Q.STEP_CAP)
    assert (Q.viterbi(x, doc, field) == line).mean() > 0.98
    assert np.abs(field.step).max() <= Q.STEP_CAP


PROSE = "The river runs past the old mill and then through the quiet town.\nPeople walk along it in the evening when the light is soft.\nNobody there remembers who had built the bridge, or why it leans."
MENU = "HOME!! NEWS!! SHOP!! CONTACT!! LOGIN!!\nhome | about | login | cart | help | terms |\nBUY!! NOW!! SALE!! SALE!! ENDS!! TODAY!!"


def test_a_mixed_text_gets_two_labels(spark):
    sf = "/root/testdata/sf0.01"
    field = Q.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    c = Q.count([f"{PROSE}\n{MENU}", f"{MENU}\n{PROSE}\n{MENU}"])
    assert Q.viterbi(c.features, c.line_doc, field).tolist() == [0, 0, 0, 1, 1, 1] + [1, 1, 1, 0, 0, 0, 1, 1, 1]
    out = Q.judge(spark.read.parquet(f"{sf}/documents.parquet"), field)
    assert out.filter("content_share > 0 and content_share < 1").count() > 20


def test_verdicts_equal_all_labellings(spark):
    """content_share and kept of the awkward rows, text by text, with every
    labelling of up to ten lines tried."""
    texts = [t for _, t in awkward_rows() if t] + [PROSE, MENU, f"{MENU}\n{PROSE}", f"{PROSE}\n\n{MENU}\n{PROSE}"]
    out = {r["doc_id"]: r for r in Q.judge(frame(spark, list(enumerate(texts))), Q.PRIOR).collect()}
    for i, text in enumerate(texts):
        c = Q.count([text])
        score = c.features @ Q.PRIOR.weight

        def value(y, score=score):
            return score @ np.array(y) + sum(Q.PRIOR.step[a, b] for a, b in itertools.pairwise(y))

        best = max(itertools.product((0, 1), repeat=len(score)), key=value)
        share = sum(int(n) for n, k in zip(c.line_words, best, strict=True) if k == Q.CONTENT) / max(1, base(text)[0])
        assert abs(out[i]["content_share"] - share) < 1e-12
        assert out[i]["kept"] == (not base(text)[-1] and share >= Q.MIN_CONTENT)


def test_long_documents_are_labelled_whole_and_sampled_in_part(spark):
    """Over a million characters; learning takes SAMPLE_LINES of its lines."""
    long = "\n".join([f"stone{i} river{i} cloud{i} winter{i} garden{i} simple{i} light{i}" for i in range(12000)] + [MENU] * 4000)
    assert len(long) > 1_000_000
    docs = frame(spark, [(1, long), (2, MENU), (3, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.fit(docs, labels).weight.shape == (len(Q.FEATURES),)
    row = Q.judge(docs, Q.PRIOR).filter("doc_id = 1").first()
    assert row["n_words"] == len(re.findall(BLANKS, long))
    assert 0 < row["content_share"] < 1
