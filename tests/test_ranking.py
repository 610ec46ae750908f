from pyspark.sql import Window
from pyspark.sql import functions as F

from proselab.plans.ranking import numbered_within, page


def test_numbering_with_hot_group(spark):
    # one group holds a third of the rows
    rows = [(0 if i % 3 == 0 else i % 50, i, (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, id long, v long")
    order = [F.col("v").desc(), F.col("id")]
    got = numbered_within(df, ["g"], order, "rn", num_partitions=7)
    exp = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.select("g", "id", "v", "rn").collect()))


def test_global_numbering_and_page(spark):
    df = spark.range(0, 95).select((F.col("id") * 3).alias("ord"))
    n = numbered_within(df, [], ["ord"], "k", num_partitions=5).collect()
    assert sorted((r["ord"], r["k"]) for r in n) == [(i * 3, i + 1) for i in range(95)]
    p = sorted(r["sample_no"] for r in page(df, ["ord"], 5, 20).collect())
    assert p == list(range(81, 96))


def test_numbering_large_enough_to_sample(spark):
    # big enough that range bounds come from sampling, not from all rows
    df = spark.range(0, 200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 101).alias("g"),
        F.col("id"),
        ((F.col("id") * 7919) % 100_003).alias("v"),
    )
    order = [F.col("v").desc(), F.col("id")]
    got = numbered_within(df, ["g"], order, "rn", num_partitions=16)
    exp = df.withColumn("rn_exp", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    bad = got.join(exp, ["g", "id"]).filter(F.col("rn") != F.col("rn_exp")).count()
    assert bad == 0
    assert got.count() == 200_000


def test_empty_inputs(spark):
    from proselab.operators import usage as U

    empty = spark.createDataFrame([], "ord long, task string")
    assert page(empty, ["ord"], 1, 20).count() == 0
    assert numbered_within(empty, [], ["ord"], "k").count() == 0
    fb = spark.createDataFrame([], "id long, user_id long, feedback_type string, comment string, created_at timestamp_ntz")
    r = U.feedback_rates(fb).first()
    assert (r["likes"], r["dislikes"], r["like_pct"], r["dislike_pct"]) == (0, 0, 0.0, 0.0)
    texts = spark.createDataFrame([(1, "123"), (2, None)], "id long, model_used string")
    assert U.top_model(texts).first()["top_model"] == "N/A"


def test_page_count(spark):
    from proselab.operators.evaluate import page_count

    for n, pages in ((0, 0), (1, 1), (20, 1), (21, 2), (95, 5)):
        r = page_count(spark.range(n)).first()
        assert (r["total_rows"], r["pages"]) == (n, pages)


def test_first_match_semantics(spark):
    from proselab.operators.evaluate import first_match

    ds = spark.createDataFrame(
        [(5, "  same text ", "t5"), (3, "same text", None), (7, "same text", "t7"), (9, "other", "t9")],
        "ord long, input_text string, target_text string",
    )
    inputs = spark.createDataFrame([(1, "same text\n"), (2, "unknown"), (3, None)], "id long, input_text string")
    got = {r["id"]: (r["matched"], r["dataset_ord"], r["reference"]) for r in first_match(inputs, "id", "input_text", ds).collect()}
    # ord 3 has no target (dropped like the reference's dropna), so ord 5 is the first match
    assert got == {1: (True, 5, "t5"), 2: (False, None, None), 3: (False, None, None)}


def test_numbering_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (None, 4)], "g long, id long")
    got = sorted((r["g"] if r["g"] is not None else -1, r["id"], r["rn"]) for r in numbered_within(df, ["g"], ["id"], "rn").collect())
    assert got == [(-1, 1, 1), (-1, 2, 2), (-1, 4, 3), (1, 3, 1)]
