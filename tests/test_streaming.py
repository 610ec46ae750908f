import os
import tempfile
from datetime import datetime

from proselab import schemas as S
from proselab.operators import usage as U
from proselab.sources import files as IO
from proselab.streaming import usage_stream as ST


def test_incremental_model_usage_and_rates(spark):
    base = tempfile.mkdtemp(prefix="proselab-stream-")
    texts, fb = os.path.join(base, "user_texts"), os.path.join(base, "user_feedback")
    IO.ensure_table(spark, texts, S.USER_TEXTS)
    IO.ensure_table(spark, fb, S.USER_FEEDBACK)
    t_schema = "id long, user_id long, input_text string, content_text string, content_type string, model_used string"
    f_schema = "id long, user_id long, feedback_type string, comment string, created_at timestamp_ntz"

    def step(t_rows, f_rows):
        IO.append_rows(spark.createDataFrame(t_rows, t_schema), texts, S.USER_TEXTS)
        IO.append_rows(spark.createDataFrame(f_rows, f_schema), fb, S.USER_FEEDBACK)
        for q in (
            ST.write_snapshots(ST.model_usage_stream(spark, texts), os.path.join(base, "out_usage"), "usage", os.path.join(base, "ck_u")),
            ST.write_snapshots(ST.feedback_rates_stream(spark, fb), os.path.join(base, "out_rates"), "rates", os.path.join(base, "ck_r")),
        ):
            q.awaitTermination()
        got = {r["model_used"]: r["usage_count"] for r in spark.read.parquet(os.path.join(base, "out_usage")).collect()}
        batch = {r["model_used"]: r["usage_count"] for r in U.model_usage(IO.read_app_table(spark, texts, S.USER_TEXTS)).collect()}
        assert got == batch
        rates = spark.read.parquet(os.path.join(base, "out_rates")).first()
        exp = U.feedback_rates(IO.read_app_table(spark, fb, S.USER_FEEDBACK)).first()
        assert (rates["likes"], rates["dislikes"]) == (exp["likes"], exp["dislikes"])

    now = datetime(2024, 1, 1)
    step([(1, 1, "a", "b", "summary", "m1"), (2, 1, "a", "b", "summary", "123"), (3, 2, "a", "b", "summary", None)],
         [(1, 1, "like", None, now)])
    step([(4, 1, "a", "b", "paraphrase", "m1"), (5, 3, "a", "b", "summary", "m2")],
         [(2, 1, "dislike", "x", now), (3, 2, "like", None, now)])
