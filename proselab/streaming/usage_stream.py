"""Incremental usage analytics over the append-only tables.

The reference recomputes its dashboard counts by re-reading ``user_texts``
and ``user_feedback`` in full on every page view.  Both tables are append
only (A8), so the same aggregates can be maintained incrementally with
Structured Streaming: new parquet files are picked up, only they are read,
and the running counts live in the state store (one small row per model /
one row for the feedback totals), checkpointed in the shared folder so a
restarted job resumes where it stopped.

Results are written per micro-batch with ``foreachBatch`` as a complete
snapshot table (tasks write it; nothing is gathered on the driver).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators.usage import ALL_DIGITS
from ..session import checkpoint_dir


def model_usage_stream(spark: SparkSession, texts_path: str) -> DataFrame:
    """D3 as a streaming aggregate over the user_texts table folder."""
    src = spark.readStream.schema(S.USER_TEXTS).parquet(texts_path)
    return (
        src.filter(~F.col("model_used").rlike(ALL_DIGITS))
        .groupBy("model_used")
        .agg(F.count(F.lit(1)).alias("usage_count"))
    )


def feedback_rates_stream(spark: SparkSession, feedback_path: str) -> DataFrame:
    """D5 as a streaming aggregate over the user_feedback table folder."""
    src = spark.readStream.schema(S.USER_FEEDBACK).parquet(feedback_path)
    agg = src.agg(
        F.count_if(F.col("feedback_type") == "like").cast("long").alias("likes"),
        F.count_if(F.col("feedback_type") == "dislike").cast("long").alias("dislikes"),
    )
    total = F.col("likes") + F.col("dislikes")
    return agg.select(
        "likes",
        "dislikes",
        total.alias("total_feedback"),
        F.when(total > 0, F.col("likes") * 100.0 / total).otherwise(F.lit(0.0)).alias("like_pct"),
        F.when(total > 0, F.col("dislikes") * 100.0 / total).otherwise(F.lit(0.0)).alias("dislike_pct"),
    )


def write_snapshots(
    stream: DataFrame, out_path: str, name: str, checkpoint_location: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Run an aggregate stream in complete mode; every micro-batch replaces
    the snapshot table at ``out_path``.  The checkpoint defaults to a
    sub-folder of the session's shared checkpoint directory."""
    ckpt = checkpoint_location or os.path.join(checkpoint_dir(stream.sparkSession), "streams", name)

    def _write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    w = stream.writeStream.outputMode("complete").option("checkpointLocation", ckpt).foreachBatch(_write).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
