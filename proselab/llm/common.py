"""Helpers shared by the training-data operators.

Null handling that every operator follows: a null text is an empty text, a
null id is a legal row whose id stays null in the result; only the columns an
operator names are read, so further columns (of any name) never clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import trim_memory
from ..session import checkpoint_dir, ship_package
from ..sources.tables import table_path
from .vocab import forget

#: bytes of text handled at once inside a task
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain scan of one driver table."""
    return spark.read.parquet(table_path(sf_dir, name))


def held_out(doc_id: Column, of: int = 5, rest: int = 0) -> Column:
    """True for the share of the documents (a fifth) that learning never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == rest


def pieces_of(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``limit`` bytes of ``column`` (a
    single longer text is a slice of its own)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(size, dtype=np.int64) - size) // limit
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def map_texts(
    df: DataFrame,
    fn: Callable[[list[str]], dict],
    schema: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Narrow map over texts: ``fn`` gets a list of texts (null as "") and
    returns column name -> values; ``keep`` columns are passed through.  The
    tokenizer caches of earlier stages are dropped first.

    ``schema`` is the DDL of the columns that ``fn`` adds."""
    ship_package(df.sparkSession)
    src = df.select(*keep, F.col(text).alias("__text"))
    out = df.select(*keep).schema
    for field in _ddl(df.sparkSession, schema):
        out = out.add(field)
    names = [f.name for f in out.fields]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        forget()
        trim_memory()
        target = to_arrow_schema(out)
        for batch in batches:
            for part in pieces_of(batch, "__text"):
                res = fn([t or "" for t in part.column("__text").to_pylist()])
                cols = [part.column(c).cast(target.field(c).type) for c in names[:n_keep]]
                cols += [pa.array(res[c], type=target.field(c).type) for c in names[n_keep:]]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        trim_memory()

    return src.mapInArrow(run, out)


def _ddl(spark: SparkSession, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/proselab-{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the
    lineage, and a lost executor never loses it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts (one narrow aggregate); sizes the partitions."""
    row = df.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return int(row["n"] or 0)
