"""Login figures kept up to date over the append-only login table.

New files are read once.  What is kept is small, and each micro-batch folds
into it: the latest logins (C3: ``n`` rows), the number of users seen so far
(D1, exact) and a mergeable sketch a day (D1 for any span of days, estimated).

Every micro-batch writes the kept table into a folder of its own, named by its
number, and readers take the latest finished one: none is ever overwritten
while it is read, and a batch that is repeated after a crash starts from its
predecessor's folder and gives the same rows.  Late files change nothing: the
results depend on the rows, not on the order of their arrival.  An output
folder belongs to one stream checkpoint; start anew with both.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators.usage import RECENT_LOGINS
from ..session import checkpoint_dir

#: what follows from the kept table (None at first) and a micro-batch
Step = Callable[[DataFrame | None, DataFrame], DataFrame]
#: log2 of a daily sketch's registers (relative error 1.6 %)
SKETCH_BITS = 12


def login_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(S.LOGIN_HISTORY).parquet(path)


# ---- kept tables ------------------------------------------------------------


def _epochs(spark: SparkSession, out_path: str) -> list[int]:
    """Numbers of the micro-batches whose table is finished."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(out_path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch-") and fs.exists(hadoop(f"{out_path}/{n}/_SUCCESS")))


def _folder(out_path: str, epoch: int) -> str:
    return f"{out_path}/batch-{epoch:010d}"


def read_kept(spark: SparkSession, out_path: str, before: int | None = None) -> DataFrame | None:
    """The latest finished table, or the latest before a micro-batch; None if
    there is none."""
    done = [e for e in _epochs(spark, out_path) if before is None or e < before]
    return spark.read.parquet(_folder(out_path, done[-1])) if done else None


def keep(
    stream: DataFrame, out_path: str, name: str, step: Step, checkpoint_location: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Fold every micro-batch into the table at ``out_path``.  The tables of
    the last two micro-batches stay, for readers and for a repeated batch."""
    spark = stream.sparkSession
    ckpt = checkpoint_location or os.path.join(checkpoint_dir(spark), "streams", name)

    def _write(batch: DataFrame, epoch: int) -> None:
        here = batch.sparkSession
        old = read_kept(here, out_path, before=epoch)
        step(old, batch).write.mode("overwrite").parquet(_folder(out_path, epoch))
        hadoop = here._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(out_path).getFileSystem(here._jsc.hadoopConfiguration())
        for gone in [e for e in _epochs(here, out_path) if e < epoch - 1]:
            fs.delete(hadoop(_folder(out_path, gone)), True)

    w = stream.writeStream.outputMode("append").option("checkpointLocation", ckpt).foreachBatch(_write).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# ---- C3 -----------------------------------------------------------------------


def latest_logins(users: Callable[[SparkSession], DataFrame], n: int = RECENT_LOGINS) -> Step:
    """The ``n`` latest logins with user name.  The latest of everything
    are among the latest so far and the latest of the batch, so a batch adds
    ``n`` rows a task to one place.  A login counts under the name its user has
    when it is read; a login without a user is left out, as in the batch join."""

    def step(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        u = users(batch.sparkSession).select(F.col("id").alias("_uid"), "username")
        new = batch.join(u, batch["user_id"] == u["_uid"], "inner").select("username", "login_time", F.col("id").alias("login_id"))
        rows = new if old is None else new.unionByName(old)
        return rows.orderBy(F.col("login_time").desc_nulls_last(), F.col("login_id").desc()).limit(n)

    return step


# ---- D1 -----------------------------------------------------------------------


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).unique()], names=["user_id"])


def first_logins(logins: DataFrame) -> DataFrame:
    """D1, exact: each user once, in the micro-batch that first has them.  A
    hot user is reduced to one row per Arrow batch before the exchange; the ids
    seen live in the state store, spread by id."""
    ids = logins.select("user_id").filter(F.col("user_id").isNotNull())
    return ids.mapInArrow(_each_once, "user_id long").dropDuplicates(["user_id"])


def count_rows(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Number of rows so far; over ``first_logins`` the unique users."""
    n = batch.agg(F.count(F.lit(1)).alias("unique_users"))
    return n if old is None else n.unionByName(old).agg(F.sum("unique_users").alias("unique_users"))


def daily_sketches(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A sketch of the users of each day; a late file adds to its own day."""
    found = batch.filter(F.col("user_id").isNotNull() & F.col("login_time").isNotNull())
    new = found.groupBy(F.to_date("login_time").alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(SKETCH_BITS)).alias("users"))
    if old is None:
        return new
    return new.unionByName(old).groupBy("day").agg(F.hll_union_agg("users").alias("users"))


def users_between(sketches: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """D1 of a span of days (both ends included), estimated from the sketches;
    0 if no day falls in it."""
    for bound, within in ((first, F.col("day") >= F.lit(first).cast("date")), (last, F.col("day") <= F.lit(last).cast("date"))):
        if bound is not None:
            sketches = sketches.filter(within)
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users")), F.lit(0)).cast("long").alias("unique_users"))
