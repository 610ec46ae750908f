"""File sources and sinks.

Readers take explicit schemas (no inference pass over the data); writers
are plain DataFrame writers, so output is produced by the tasks that hold
the rows, never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..plans.ranking import numbered_within

_CSV_OPTS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def _in_file_order(df: DataFrame, out: str) -> DataFrame:
    """``out`` = 0-based position of each row in the files, taken in order of
    their paths: rows are range-partitioned on (path, start of the split) and
    numbered along.  Within a split, ``monotonically_increasing_id`` follows
    the reader."""
    at = ["_path", "_start", "_seq"]
    x = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    x = x.withColumn("_seq", F.monotonically_increasing_id())
    return numbered_within(x, [], at, out).withColumn(out, F.col(out) - 1).drop(*at)


def read_dataset_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """A1: the dataset CSV (input_text, target_text, task, domain).  Empty
    fields stay NULL (B2 drops them).  ``ord`` is the position in file order.

    ``multi_line`` fields may hold line breaks, which means that a file is
    read by one task; for large files without such fields switch it off, and
    files are split."""
    df = spark.read.schema(S.DATASET).options(**_CSV_OPTS | {"multiLine": str(multi_line).lower()}).csv(path)
    return _in_file_order(df, "ord")


def read_eval_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """A2: evaluation CSV, every column a string, empty -> '' (as a
    dict reader gives).  ``pid`` is the position in file order."""
    df = spark.read.schema(S.EVAL_CSV).options(**_CSV_OPTS | {"multiLine": str(multi_line).lower()}).csv(path)
    return _in_file_order(df, "pid").select("pid", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in S.EVAL_CSV.fieldNames()])


def read_text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A4: whole UTF-8 text files, one row per file with its path."""
    df = spark.read.text(paths, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


EVAL_OUTPUT_COLUMNS = ["original", "reference", "generated_conservative", "generated_balanced", "generated_creative"]


def write_eval_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: CSV with header and the fixed column order of the filled file."""
    df.select(*EVAL_OUTPUT_COLUMNS).write.mode(mode).options(header="true", quoteAll="true", escape='"').csv(path)


def run_stamp() -> Column:
    """``YYYYmmdd-HHMMSS`` of the query start time."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss")


def write_report(scored: DataFrame, levels: DataFrame, path: str, stamp: str | None = None) -> str:
    """The ROUGE report, in a folder of its own named by the time of the
    run (or ``stamp``), so that no report replaces an earlier one.  Returns
    the folder.

    ``aggregate`` — ONE JSON object ``{level: {rouge1_f_mean, ..., count}}``
    built from the 3 per-level rows (bounded size).  ``per_level`` — the
    scored rows as JSON lines partitioned by level (written by the tasks, not
    nested into one object, so it scales with the data).  Non-ASCII text is
    written as is."""
    stamp = stamp or scored.sparkSession.range(1).select(run_stamp().alias("s")).first()["s"]
    folder = f"{path}/rouge_results_{stamp}"
    agg = levels.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.col("level"),
                    F.struct("rouge1_f_mean", "rouge2_f_mean", "rougeL_f_mean", "count"),
                )
            )
        ).alias("aggregate")
    )
    agg.coalesce(1).write.mode("errorifexists").json(f"{folder}/aggregate")
    scored.select(
        "level", "original", "reference", "generated", "rouge1_f", "rouge2_f", "rougeL_f"
    ).write.mode("errorifexists").partitionBy("level").json(f"{folder}/per_level")
    return folder


def write_preset_texts(results: DataFrame, key: str, text_col: str, out_col: str, path: str, mode: str = "overwrite") -> None:
    """The texts of each length preset as JSON lines under
    ``path/preset=<p>``: key, input and summary side by side.  A text is one
    value, so its line breaks do not break rows."""
    out = results.select(F.col(key), "preset", F.col(text_col).alias("input"), F.col(out_col).alias("summary"))
    out.write.mode(mode).partitionBy("preset").json(path)


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fill missing columns: ``created_at`` / ``login_time`` = now (the SQL
    column default), everything else NULL; columns in schema order."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name in ("created_at", "login_time"):
            cols.append(F.localtimestamp().cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Create the table (an empty parquet dataset with the fixed
    schema) only if it does not exist yet."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def append_rows(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append rows to a table, applying column defaults.  Rows without an
    ``id`` get the next ones after the table's largest, as an auto-increment
    column gives them."""
    spark = df.sparkSession
    if "id" in schema.fieldNames() and "id" not in df.columns:
        last = read_app_table(spark, path, schema).agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        rows = df.withColumn("_seq", F.monotonically_increasing_id())
        df = numbered_within(rows, [], ["_seq"], "id").withColumn("id", F.col("id") + last).drop("_seq")
    with_defaults(df, schema).write.mode("append").parquet(path)


def read_app_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


# --------------------------------------------------------------- JDBC (A3) --
def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    num_partitions: int = 64,
) -> DataFrame:
    """A3 against the live database: a range-partitioned parallel read.

    With ``partition_column`` (a numeric key such as ``id``), its bounds
    come from a one-row ``min/max`` query and each task reads one key range
    (``num_partitions`` concurrent connections).  Without it the table is
    read by a single connection.  Filters and projections applied to the
    result are pushed into the SQL sent to the database."""
    props = dict(properties or {})
    if not partition_column:
        return spark.read.jdbc(url, table, properties=props)
    bounds = spark.read.jdbc(
        url, f"(SELECT min({partition_column}) AS lo, max({partition_column}) AS hi FROM {table}) b", properties=props
    ).first()
    if bounds is None or bounds["lo"] is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=int(bounds["lo"]),
        upperBound=int(bounds["hi"]) + 1,
        numPartitions=num_partitions,
        properties=props,
    )


def append_jdbc(df: DataFrame, url: str, table: str, schema: T.StructType, properties: dict[str, str] | None = None, batch_size: int = 1000) -> None:
    """A8 against the live database: append with column defaults, one
    batched insert stream per task."""
    with_defaults(df, schema).write.option("batchsize", str(batch_size)).jdbc(url, table, mode="append", properties=dict(properties or {}))
