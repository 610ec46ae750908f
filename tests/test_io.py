import json
import os
import tempfile

from pyspark.sql import functions as F

from proselab import schemas as S
from proselab.operators import evaluate as EV
from proselab.sources import files as IO


def _tmp():
    return tempfile.mkdtemp(prefix="proselab-io-")


def test_dataset_csv_roundtrip(spark):
    d = _tmp()
    p = os.path.join(d, "ds.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('input_text,target_text,task,domain\n"multi\nline, ""quoted""",t1,summary,news\n,t2,paraphrase,science\nx,,summary,medical\n')
    df = IO.read_dataset_csv(spark, p)
    rows = df.orderBy("ord").collect()
    assert rows[0]["input_text"] == 'multi\nline, "quoted"'
    assert rows[1]["input_text"] is None
    clean = df.na.drop(subset=["input_text", "target_text"])
    assert clean.count() == 1


def test_eval_csv_write_and_read(spark):
    d = _tmp()
    src = spark.createDataFrame([("o", "r", "c", None, "é")], "original string, reference string, generated_conservative string, generated_balanced string, generated_creative string")
    IO.write_eval_csv(src, os.path.join(d, "out"))
    back = IO.read_eval_csv(spark, os.path.join(d, "out")).first()
    assert (back["original"], back["generated_balanced"], back["generated_creative"]) == ("o", "", "é")


def test_text_files(spark):
    d = _tmp()
    for i in range(2):
        with open(os.path.join(d, f"f{i}.txt"), "w", encoding="utf-8") as f:
            f.write(f"line one {i}\nline two ü\n")
    rows = IO.read_text_files(spark, d).collect()
    assert len(rows) == 2 and all(r["text"].endswith("ü\n") for r in rows)


def test_report_sink(spark):
    d = _tmp()
    rows = spark.createDataFrame(
        [(1, "o", "the cat", "the cat", "a cat", "ünïcode cat")],
        "pid long, original string, reference string, generated_conservative string, generated_balanced string, generated_creative string",
    )
    scored = EV.eval_rows(rows, "pid")
    levels = EV.level_summary(scored)
    folder = IO.write_report(scored, levels, d)
    assert os.path.basename(folder).startswith("rouge_results_2")
    agg_files = [f for f in os.listdir(os.path.join(folder, "aggregate")) if f.endswith(".json")]
    obj = json.loads(open(os.path.join(folder, "aggregate", agg_files[0]), encoding="utf-8").read())
    assert set(obj["aggregate"]) == set(S.LEVELS) and obj["aggregate"]["conservative"]["count"] == 1
    per = spark.read.json(os.path.join(folder, "per_level"))
    assert per.count() == 3
    assert per.filter(F.col("level") == "creative").first()["generated"] == "ünïcode cat"
    # a second report stands beside the first
    IO.write_report(scored, levels, d, stamp="20990101-000000")
    assert len([f for f in os.listdir(d) if f.startswith("rouge_results_")]) == 2
    assert spark.read.json(os.path.join(folder, "per_level")).count() == 3


def test_preset_text_sink(spark):
    d = _tmp()
    res = spark.createDataFrame([(1, "short", "in\ntext", "sum"), (1, "long", "in\ntext", "sum2"), (2, "short", "é", "x\ny")], "doc_id long, preset string, text string, summary string")
    IO.write_preset_texts(res, "doc_id", "text", "summary", d)
    assert sorted(x for x in os.listdir(d) if x.startswith("preset=")) == ["preset=long", "preset=short"]
    back = spark.read.json(d).orderBy("preset", "doc_id").select("preset", "doc_id", "input", "summary").collect()
    assert [tuple(r) for r in back] == [("long", 1, "in\ntext", "sum2"), ("short", 1, "in\ntext", "sum"), ("short", 2, "é", "x\ny")]


def test_ensure_and_append(spark):
    d = os.path.join(_tmp(), "user_texts")
    IO.ensure_table(spark, d, S.USER_TEXTS)
    IO.ensure_table(spark, d, S.USER_TEXTS)  # second call is a no-op
    assert IO.read_app_table(spark, d, S.USER_TEXTS).count() == 0
    new = spark.createDataFrame([(1, 5, "in", "out", "summary", "m")], "id long, user_id long, input_text string, content_text string, content_type string, model_used string")
    IO.append_rows(new, d, S.USER_TEXTS)
    IO.append_rows(new, d, S.USER_TEXTS)
    t = IO.read_app_table(spark, d, S.USER_TEXTS)
    assert t.count() == 2 and t.filter(F.col("created_at").isNull()).count() == 0


def test_run_stamp(spark):
    v = spark.range(1).select(IO.run_stamp().alias("s")).first()["s"]
    assert len(v) == 15 and v[8] == "-"


def test_order_follows_files_not_scan_packing(spark):
    d = _tmp()
    for name, n in (("part-0.csv", 3), ("part-1.csv", 4000)):
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write("input_text,target_text,task,domain\n" + "".join(f"in {i},{name} {i},t,d\n" for i in range(n)))
    for multi in (True, False):
        rows = [r["target_text"] for r in IO.read_dataset_csv(spark, d, multi).orderBy("ord").collect()]
        assert rows == [f"part-0.csv {i}" for i in range(3)] + [f"part-1.csv {i}" for i in range(4000)]
    inputs = spark.createDataFrame([(1, " in 2 ")], "id long, input_text string")
    m = EV.first_match(inputs, "id", "input_text", IO.read_dataset_csv(spark, d)).first()
    assert (m["dataset_ord"], m["reference"]) == (2, "part-0.csv 2")


def test_filled_rows_go_into_the_wide_csv(spark):
    from proselab.operators import generate as G

    rows = spark.createDataFrame([(1, "Some text.", "ref")], "pid long, original string, reference string")
    out = os.path.join(_tmp(), "filled")
    IO.write_eval_csv(G.fill_levels(rows, "pid", "original"), out)
    back = IO.read_eval_csv(spark, out).first()
    assert (back["pid"], back["original"], back["reference"], back["generated_creative"]) == (0, "Some text.", "ref", "Some text.")


def test_append_numbers_rows_without_id(spark):
    d = os.path.join(_tmp(), "user_feedback")
    IO.ensure_table(spark, d, S.USER_FEEDBACK)
    new = spark.createDataFrame([(5, "like"), (6, "dislike"), (7, "like")], "user_id long, feedback_type string")
    IO.append_rows(new, d, S.USER_FEEDBACK)
    IO.append_rows(new, d, S.USER_FEEDBACK)
    t = IO.read_app_table(spark, d, S.USER_FEEDBACK)
    assert sorted(r["id"] for r in t.collect()) == [1, 2, 3, 4, 5, 6]
    assert [r["user_id"] for r in t.orderBy("id").collect()] == [5, 6, 7] * 2
