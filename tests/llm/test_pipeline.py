import random
from collections import defaultdict

import corpus_pipeline as C
from proselab.llm.common import saved

from .helpers import frame, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "pid", "length", "__id", "n_bytes"]


def rows():
    rng = random.Random(1)
    text = [" ".join(f"{rng.choice(['stone', 'river', 'cloud'])}{rng.randrange(900)}" for _ in range(80)) for _ in range(6)]
    passage = prose(rng, 60)
    near = text[0].replace(text[0].split()[40], "changed")
    return [
        (10, text[0]), (11, text[0]), (12, near), (13, text[1]), (14, text[2] + " " + passage), (15, passage + " " + text[3]),
        (16, "write to a@b.org " + text[4]), (17, None), (18, "... 123 !!!"), (19, text[5]), (19, text[5]), (None, "no id " + text[5][:30]),
    ]


def test_each_stage_does_its_work(spark):
    docs = frame(spark, rows())
    ids = lambda d: sorted(r["doc_id"] for r in d.filter("doc_id is not null").select("doc_id").collect())
    seen = {}
    for name, stage in C.STAGES:
        docs = saved(stage(spark, docs, ""), name)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
    assert ids(seen["language_id"]) == [10, 11, 12, 13, 14, 15, 16, 19, 19]
    assert ids(seen["near_duplicates"]) == [10, 13, 14, 15, 16, 19]
    assert seen["near_duplicates"].filter("doc_id is null").count() == 1
    left = {r["doc_id"]: r for r in seen["repeated_passages"].collect()}
    assert len(left[15]["text"]) < 1000 and left[15]["n_chars"] == len(left[15]["text"])
    assert left[13]["text"] == rows()[3][1] and left[13]["score"] == "x"
    masked = {r["doc_id"]: r["text"] for r in seen["personal_data"].collect()}
    assert masked[16].startswith("write to <EMAIL> ")
    bins = defaultdict(int)
    for r in docs.collect():
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= C.CAPACITY


def test_whole_run_and_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert C.run(spark, f"{tmp_path}/none").collect() == []
    frame(spark, rows()).write.parquet(f"{tmp_path}/some/documents.parquet")
    out = C.run(spark, f"{tmp_path}/some").collect()
    assert {r["doc_id"] for r in out} == {10, 13, 14, 15, 16, 19, None}


def test_rows_that_share_an_id_and_clashing_columns(spark):
    """Different texts under one id all stay; columns come back as they were,
    whatever their names."""
    text = {i: t for i, t in rows() if t}
    names = ["doc_id", "text", "__nth", "__gone", "__row", "masked", "__null", "component_id", "lang"]
    some = [(1, text[10]), (1, text[13]), (2, text[11]), (None, text[19]), (None, text[14]), (3, text[14])]
    docs = spark.createDataFrame([(i, t, 77 + k, "g", 5, "m", "n", 6, "en") for k, (i, t) in enumerate(some)], "doc_id long, text string, __nth int, __gone string, __row int, masked string, __null string, component_id int, lang string")
    out = C.near_duplicates(spark, docs, "")
    assert out.columns == names
    assert sorted((r["__nth"], r["doc_id"], r["text"] == some[r["__nth"] - 77][1], *r[3:]) for r in out.collect()) == [
        (77, 1, True, "g", 5, "m", "n", 6, "en"), (78, 1, True, "g", 5, "m", "n", 6, "en"), (80, None, True, "g", 5, "m", "n", 6, "en"), (81, None, True, "g", 5, "m", "n", 6, "en")
    ]
    for name, stage in C.STAGES[:-1]:
        docs = saved(stage(spark, docs, ""), name)
        assert docs.columns == names
    assert {r["__nth"] for r in docs.collect()} == {77, 78, 80, 81}
