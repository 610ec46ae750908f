import pandas as pd
import pytest
from pyspark.sql import functions as F

from proselab.operators import generate as G


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n,chunks", [(0, 0), (1, 1), (512, 1), (513, 2), (1024, 2), (1025, 3)])
def test_chunk_boundaries(spark, n, chunks):
    text = " \n".join(f"w{i}" for i in range(n))
    out = G.chunk(_docs(spark, [text]), "doc_id", "text").orderBy("chunk_no").collect()
    assert len(out) == chunks
    if chunks:
        assert [r["n_tokens"] for r in out][:-1] == [512] * (chunks - 1)
        merged = " ".join(r["chunk_text"] for r in out)
        assert merged == " ".join(text.split())


def test_chunk_then_merge_is_identity(spark):
    texts = ["  a b\tc ", "", "x " * 1500, "one"]
    c = G.chunk(_docs(spark, texts), "doc_id", "text")
    m = {r["doc_id"]: r["merged"] for r in G.merge_ordered(c, "doc_id", "chunk_no", "chunk_text").collect()}
    for i, t in enumerate(texts):
        if t.split():
            assert m[i] == " ".join(t.split())
        else:
            assert i not in m


def test_extract_summary_rules():
    text = "Cats purr. Cats purr and cats sleep. Dogs bark!  "
    # mean in-text word frequency: s0 (3+2)/2 = 2.5, s1 10/5 = 2.0, s2 1.0
    assert G.extract_summary(text, 4, 0) == "Cats purr."
    # min_len 3: s1 is taken because only 2 words were kept before it
    assert G.extract_summary(text, 4, 3) == "Cats purr. Cats purr and cats sleep."
    assert G.extract_summary(text, 100, 0) == "Cats purr. Cats purr and cats sleep. Dogs bark!"
    assert G.extract_summary("", 10, 5) == ""
    assert G.extract_summary("...", 10, 5) == ""  # no sentence: only terminal marks


def test_summarize_long_and_empty(spark):
    long_text = " ".join(f"Sentence number {i} talks about topic {i % 7}." for i in range(300))
    out = {r["doc_id"]: r["summary"] for r in G.summarize(_docs(spark, [long_text, "", "Summary: short text."]), "doc_id", "text").collect()}
    assert out[1] == ""
    assert out[2] == "short text."
    assert 0 < len(out[0].split()) <= 100 + 20


def test_plugin_generator_and_error_capture(spark):
    def upper_gen(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"candidates": [[t.upper(), t] for t in pdf["text"]], "error": [None] * len(pdf)})

    def failing_gen(pdf: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("model offline")

    req = spark.createDataFrame([(1, "hello there", "creative", "t5"), (2, "ab", "balanced", "t5")], "rid long, text string, level string, model_name string")
    ok = G.paraphrase_response(req, "rid", upper_gen).collect()
    assert len(ok) == 1 and ok[0]["paraphrases"] == ["HELLO THERE"] or ok[0]["paraphrases"] == ["hello there"]
    assert ok[0]["generation_params"]["temperature"] == 1.2
    rows = spark.createDataFrame([(1, "Some text here.")], "pid long, original string")
    bad = G.fill_levels(rows, "pid", "original", failing_gen).first()
    assert bad["generated_balanced"] is None
    assert bad["error_balanced"].startswith("RuntimeError: model offline")


def test_plugin_generator_keeps_rows(spark):
    def echo(pdf):
        return pd.DataFrame({"candidates": [[f"v:{t}"] for t in pdf["text"]]})

    docs = _docs(spark, ["a b c.", "d e f."])
    g = G.run_generator(docs, "doc_id", "text", echo, [], "out").select("doc_id", "out", "error").collect()
    assert sorted((r["doc_id"], r["out"], r["error"]) for r in g) == [(0, "v:a b c.", None), (1, "v:d e f.", None)]


def test_split_valid_reasons(spark):
    req = spark.createDataFrame([(1, "ok text"), (2, "ab"), (3, "     ")], "rid long, text string")
    valid, rejected = G.split_valid(req)
    assert [r["rid"] for r in valid.collect()] == [1]
    assert sorted((r["rid"], r["reason"]) for r in rejected.collect()) == [(2, "too short"), (3, "empty text")]


def test_plugin_generator_gets_decode_params(spark):
    seen = []

    def probe(pdf):
        out = []
        for gp in pdf["_gp"]:
            gp = gp if isinstance(gp, dict) else gp.asDict() if hasattr(gp, "asDict") else dict(gp)
            out.append([f"T{gp['temperature']} N{gp['no_repeat_ngram_size']} L{gp['max_length']} B{gp['num_beams']}."])
        return pd.DataFrame({"candidates": out})

    long_text = " ".join(f"Word{i}." for i in range(700))
    res = G.summarize(_docs(spark, [long_text]), "doc_id", "text", 70, 40, probe, length_penalty=1.5, num_beams=5).first()
    # the final text comes from the second pass: it carries the second-pass knobs
    assert res["summary"] == "T0.3 N4 L70 B5."
    chunks = G.paraphrase_long(_docs(spark, [long_text]), "doc_id", "text", 70, 40, probe, 512, 1.5, 5).first()
    assert chunks["paraphrase"] == "TNone NNone L70 B5. TNone NNone L70 B5."


def test_preset_sweep_plugin_and_standin(spark):
    def echo(pdf):
        return pd.DataFrame({"candidates": [[f"L{gp['max_length']}"] for gp in pdf["_gp"]]})

    short = "One short text. It has two sentences."
    long_text = " ".join(f"Word{i}." for i in range(600))
    docs = _docs(spark, [short, long_text])
    plug = sorted((r["doc_id"], r["preset"], r["summary"]) for r in G.preset_sweep(docs, "doc_id", "text", echo).collect())
    assert plug[:3] == [(0, "long", "L100"), (0, "medium", "L70"), (0, "short", "L45")]
    assert [p[1] for p in plug[3:]] == ["long", "medium", "short"] and plug[3][2] == "L100"
    std = {(r["doc_id"], r["preset"]): r["summary"] for r in G.preset_sweep(docs, "doc_id", "text").collect()}
    assert len(std) == 6 and std[(0, "short")] == short


def test_failed_chunks_are_reported(spark):
    def picky(pdf):
        if pdf["piece"].str.contains("BAD").any():
            raise RuntimeError("no")
        return pd.DataFrame({"candidates": [[t[:2]] for t in pdf["piece"]]})

    words = ["a0"] * 512 + ["BAD"] + ["b0"] * 511 + ["c0"] * 3
    docs = _docs(spark, [" ".join(words), "d0 d1", "", " ".join(words[:512])])
    out = {r["doc_id"]: r for r in G.paraphrase_long(docs, "doc_id", "text", generator=picky).collect()}
    assert (out[0]["paraphrase"], out[0]["failed_chunks"], out[0]["error"]) == ("a0 c0", 1, "RuntimeError: no")
    assert [(out[i]["paraphrase"], out[i]["failed_chunks"], out[i]["error"]) for i in (1, 2, 3)] == [("d0", 0, None), ("", 0, None), ("a0", 0, None)]


def test_errors_reach_routes_and_sweep(spark):
    def second_fails(pdf):
        col = "_second" if "_second" in pdf else "piece"
        if col == "_second":
            raise RuntimeError("late")
        return pd.DataFrame({"candidates": [["x"] for _ in pdf[col]]})

    docs = _docs(spark, ["w " * 600, "short one"])
    routed = {r["doc_id"]: r for r in G.route_summaries(docs, "doc_id", "text", 70, 40, second_fails).collect()}
    assert (routed[0]["path"], routed[0]["summary"], routed[0]["error"]) == ("long", None, "RuntimeError: late")
    assert (routed[1]["path"], routed[1]["summary"], routed[1]["error"]) == ("direct", "x", None)
    swept = {(r["doc_id"], r["preset"]): r["error"] for r in G.preset_sweep(docs, "doc_id", "text", second_fails).collect()}
    assert {k for k, e in swept.items() if e} == {(0, "long")} and len(swept) == 6


def test_prompt_and_banned_terms_reach_the_generator(spark):
    def show(pdf):
        gp = pdf["_gp"].iloc[0]
        return pd.DataFrame({"candidates": [[f"{len(gp['banned_terms'])} {gp['prompt']}"] for _ in range(len(pdf))]})

    from proselab import schemas as S

    docs = _docs(spark, ["some text"])
    plain = G.route_summaries(docs, "doc_id", "text", 70, 40, show).first()["summary"]
    assert plain == f"{len(S.BANNED_TERMS)} some text"
    asked = G.route_summaries(docs, "doc_id", "text", 70, 40, show, model="x/Pegasus").first()["summary"]
    assert asked == f"{len(S.BANNED_TERMS)} {S.PEGASUS_PROMPT}some text"


def test_request_values_and_defaults(spark):
    req = spark.createDataFrame(
        [(1, "hello there", "creative", "t5", 3, 20), (2, "hello again", "x", "t5", None, None)],
        "rid long, text string, level string, model_name string, num_return_sequences int, max_new_tokens int",
    )

    def many(pdf):
        return pd.DataFrame({"candidates": [[f"v{i}" for i in range(gp["num_return_sequences"])] for gp in pdf["gp"]]})

    out = {r["rid"]: r for r in G.paraphrase_response(req, "rid", many).collect()}
    assert out[1]["paraphrases"] == ["v0", "v1", "v2"] and out[1]["generation_params"]["max_new_tokens"] == 20
    assert out[2]["paraphrases"] == ["v0"] and out[2]["generation_params"]["max_new_tokens"] == 50


def test_fill_levels_keeps_the_row(spark):
    def by_level(pdf):
        return pd.DataFrame({"candidates": [[f"{v} {t}", "second"] for v, t in zip(pdf["level"], pdf["original"])]})

    rows = spark.createDataFrame([(1, "Some text.", "ref", "extra")], "pid long, original string, reference string, note string")
    r = G.fill_levels(rows, "pid", "original", by_level).first()
    assert (r["original"], r["reference"], r["note"]) == ("Some text.", "ref", "extra")
    assert [r[f"generated_{v}"] for v in ("conservative", "balanced", "creative")] == [f"{v} Some text." for v in ("conservative", "balanced", "creative")]
    s = G.fill_levels(rows, "pid", "original").first()
    assert s["reference"] == "ref" and s["generated_balanced"] == "Some text."


def test_udfs_hold_one_text_at_a_time():
    """the rows of a batch become Python strings one by one."""
    import pyarrow as pa

    from proselab.functions import arrow as A

    texts = pa.array([f"text {i}" for i in range(1000)])
    taken = A.texts_of(texts)
    assert next(taken) == "text 0" and not isinstance(taken, list)
    live, most = 0, 0

    def results():
        nonlocal live, most
        for t in A.texts_of(texts):
            live += 1
            most = max(most, live)
            yield [t, None]
            live = 0 if live == A.ROWS else live

    out = A.one_by_one(pa.list_(pa.string()), results())
    assert out.to_pylist() == [[t, None] for t in texts.to_pylist()] and most <= A.ROWS
    assert A.one_by_one(pa.string(), []).to_pylist() == []
