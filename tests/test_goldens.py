"""The two stored ROUGE reports of the reference, retyped as goldens.

FIXED VALUES: (level, reference, generated, rouge1_f, rouge2_f, rougeL_f)
per report, and the per-level aggregates, copied from the reports."""

import pytest
from pyspark.sql import functions as F

from proselab.operators import evaluate as EV

REPORT_1 = [
    ("conservative", "Machine learning gets better as data increases.", "Machine learning improves with more data.", 0.4615384615384615, 0.1818181818181818, 0.4615384615384615),
    ("conservative", "The cat rested on the rug.", "The cat sat on the mat.", 0.6666666666666666, 0.4000000000000001, 0.6666666666666666),
    ("conservative", "AI is transforming the world.", "Artificial Intelligence is changing the world.", 0.5454545454545454, 0.22222222222222224, 0.5454545454545454),
    ("balanced", "Machine learning gets better as data increases.", "Machine learning improves with more data.", 0.4615384615384615, 0.1818181818181818, 0.4615384615384615),
    ("balanced", "The cat rested on the rug.", "My cat sat on the mat.", 0.5, 0.20000000000000004, 0.5),
    ("balanced", "AI is transforming the world.", "Artificial Intelligence is changing the world, and will bring enormous benefits to mankind. How can I improve my overall quality of life?", 0.22222222222222218, 0.08, 0.22222222222222218),
    ("creative", "Machine learning gets better as data increases.", "Machine learning for data mining, automata, and simulation with data analysis increases as data increases.", 0.4545454545454545, 0.3, 0.4545454545454545),
    ("creative", "The cat rested on the rug.", "My cat sat on a mat (so did his owner). My cat then got back under the mat. I got this mat on the next floor too.", 0.24242424242424243, 0.06451612903225806, 0.1818181818181818),
    ("creative", "AI is transforming the world.", "Artificial Intelligence is making possible artificial intelligence to solve problems.", 0.13333333333333333, 0.0, 0.13333333333333333),
]
AGG_1 = {
    "conservative": (0.5578865578865578, 0.26801346801346804, 0.5578865578865578, 3),
    "balanced": (0.39458689458689455, 0.15393939393939393, 0.39458689458689455, 3),
    "creative": (0.2767676767676768, 0.12150537634408602, 0.25656565656565655, 3),
}
REPORT_2 = [
    ("conservative", "Machine learning gets better as data increases.", "Machine learning improves with more data.", 0.4615384615384615, 0.1818181818181818, 0.4615384615384615),
    ("conservative", "The cat rested on the rug.", "The cat sat on the mat.", 0.6666666666666666, 0.4000000000000001, 0.6666666666666666),
    ("conservative", "AI is transforming the world.", "Artificial Intelligence is changing the world.", 0.5454545454545454, 0.22222222222222224, 0.5454545454545454),
    ("balanced", "Machine learning gets better as data increases.", "Machine learning improves with more data.", 0.4615384615384615, 0.1818181818181818, 0.4615384615384615),
    ("balanced", "The cat rested on the rug.", "The cat sat on the mat. The cat wiggled her tail.", 0.4705882352941177, 0.26666666666666666, 0.4705882352941177),
    ("balanced", "AI is transforming the world.", "Artificial Intelligence (AI) is changing the world.", 0.6666666666666666, 0.4, 0.6666666666666666),
    ("creative", "Machine learning gets better as data increases.", "Machine Learning is improving with more data.", 0.42857142857142855, 0.16666666666666666, 0.42857142857142855),
    ("creative", "The cat rested on the rug.", "The cat was seated on the mat. I was shocked.", 0.5, 0.2857142857142857, 0.5),
    ("creative", "AI is transforming the world.", "Artificial intelligence (AI) is changing the world in a good way.", 0.5000000000000001, 0.28571428571428575, 0.5000000000000001),
]
AGG_2 = {
    "conservative": (0.5578865578865578, 0.26801346801346804, 0.5578865578865578, 3),
    "balanced": (0.5329311211664153, 0.2828282828282828, 0.5329311211664153, 3),
    "creative": (0.4761904761904762, 0.24603174603174605, 0.4761904761904762, 3),
}


def _wide(spark, report):
    """Back to the evaluation-CSV shape: one row per reference, a column
    per level (original = the conservative text, as in the reports)."""
    by_ref = {}
    for level, ref, gen, *_ in report:
        by_ref.setdefault(ref, {})[level] = gen
    rows = [
        (i, d["conservative"], ref, d["conservative"], d["balanced"], d["creative"])
        for i, (ref, d) in enumerate(by_ref.items())
    ]
    return spark.createDataFrame(
        rows, "pid long, original string, reference string, generated_conservative string, generated_balanced string, generated_creative string"
    )


@pytest.mark.parametrize("report,agg", [(REPORT_1, AGG_1), (REPORT_2, AGG_2)])
@pytest.mark.parametrize("stem", [True, False])
def test_report_rows_and_aggregates(spark, report, agg, stem):
    rows = EV.eval_rows(_wide(spark, report), "pid", stem=stem).collect()
    got = {(r["level"], r["reference"], r["generated"]): (r["rouge1_f"], r["rouge2_f"], r["rougeL_f"]) for r in rows}
    assert len(got) == len(report)
    for level, ref, gen, r1, r2, rl in report:
        g = got[(level, ref, gen)]
        assert g == pytest.approx((r1, r2, rl), abs=1e-12)
    levels = EV.level_summary(EV.eval_rows(_wide(spark, report), "pid", stem=stem)).collect()
    for r in levels:
        m1, m2, ml, n = agg[r["level"]]
        assert (r["rouge1_f_mean"], r["rouge2_f_mean"], r["rougeL_f_mean"]) == pytest.approx((m1, m2, ml), abs=1e-12)
        assert r["count"] == n


def test_empty_level_reports_zeros(spark):
    df = spark.createDataFrame(
        [(1, "a b", "  ", "a", "b", "c")],
        "pid long, original string, reference string, generated_conservative string, generated_balanced string, generated_creative string",
    )
    out = EV.level_summary(EV.eval_rows(df, "pid")).collect()
    assert [r["level"] for r in out] == ["conservative", "balanced", "creative"]
    assert all(r["count"] == 0 and r["rouge1_f_mean"] == 0.0 for r in out)


def test_blank_generated_falls_back_to_original(spark):
    df = spark.createDataFrame(
        [(1, " the cat sat ", "the cat sat", "", None, "   ")],
        "pid long, original string, reference string, generated_conservative string, generated_balanced string, generated_creative string",
    )
    rows = EV.eval_rows(df, "pid").collect()
    assert {r["generated"] for r in rows} == {"the cat sat"}
    assert all(r["rouge1_f"] == 1.0 and r["rougeL_f"] == 1.0 for r in rows)
