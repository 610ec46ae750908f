"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned on ``doc_id``; each task streams its ids into
one ``.bin`` file and the bounds of its documents into one ``.idx`` file.  The
manifest (one row per file) holds each file's base, the prefix sum of the ids
in the files before it.  Readers memory-map the files.

Layout, all little-endian:
  ``.bin``  ids, unsigned 16-bit if the vocabulary has at most 65,536 ids, else
            unsigned 32-bit; no header
  ``.idx``  int64 n; int64 offsets[n + 1] (in ids, from 0 in this file);
            int64 doc_id[n]; uint8 doc_id_is_null[n]
  ``manifest/``  Parquet: file, first_doc, n_docs, n_tokens, width, base

Null texts are empty (only the end id); null ids come first; rows that repeat
a ``doc_id`` are all written, in order of their texts; an empty table gives an
empty manifest.  A file's name holds the task attempt that wrote it, so a
retried task never touches a file that the manifest names.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import pieces_of
from .vocab import library_cache

MANIFEST = "file string, first_doc bigint, n_docs bigint, n_tokens bigint, width int"
TOKENS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI; plain and ``file:`` paths are local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, width: int = 2, vocab_folder: str | None = None
) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each document and
    write the files under ``folder``; returns the manifest as read back."""
    spark = docs.sparkSession
    ship_package(spark)
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        fs, root = _fs(folder)
        cache, end = library_cache(vocabulary, vocab_folder), np.uint32(end_id).tobytes()
        sizes, ids = [], []
        with contextlib.ExitStack() as open_files:
            out = None
            for batch in batches:
                for part in pieces_of(batch):
                    got = [x + end for x in cache.of([t or "" for t in part.column("text").to_pylist()])]
                    sizes += [len(x) // 4 for x in got]
                    ids += part.column("doc_id").to_pylist()
                    out = out or open_files.enter_context(fs.open_output_stream(f"{root}/{name}.bin"))
                    out.write(np.frombuffer(b"".join(got), "<u4").astype(f"<u{width}").tobytes())
        if not ids:
            return
        offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        with fs.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.array([len(ids)], "<i8").tobytes() + offsets.astype("<i8").tobytes())
            out.write(np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes())
        row = {"file": [name], "first_doc": [ids[0]], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])], "width": [width]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema(
            [("file", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]
        ))

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/written")
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file: the only thing that is ever brought together
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/written")
    files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST + ", base bigint").parquet(f"{folder}/manifest")


def read_index(folder: str, name: str) -> tuple[np.ndarray, list]:
    """Offsets and document ids of one file."""
    fs, root = _fs(folder)
    with fs.open_input_file(f"{root}/{name}.idx") as f:
        raw = f.read()
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    offsets = np.frombuffer(raw, "<i8", n + 1, 8)
    ids = np.frombuffer(raw, "<i8", n, 16 + 8 * n).tolist()
    null = np.frombuffer(raw, "u1", n, 16 + 16 * n)
    return offsets, [None if z else i for i, z in zip(ids, null, strict=True)]


@contextlib.contextmanager
def open_ids(folder: str, name: str, width: int):
    """``read(start, stop) -> ids`` on one file: a memory map where the folder
    is a mounted one, positioned reads in any other store."""
    fs, root = _fs(folder)
    path = f"{root}/{name}.bin"
    if isinstance(fs, pafs.LocalFileSystem):
        ids = np.memmap(path, f"<u{width}", mode="r")
        yield lambda a, b: ids[a:b]
    else:
        with fs.open_input_file(path) as f:
            yield lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), f"<u{width}")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, all from the files: ``doc_id``, ``start`` (ids of
    all documents before it), ``n_tokens`` and the crc32 of its ids as
    little-endian unsigned 32-bit integers."""
    ship_package(spark)
    manifest = spark.read.schema(MANIFEST + ", base bigint").parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offsets, ids = read_index(folder, row["file"])
                crc = []
                with open_ids(folder, row["file"], row["width"]) as read:
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                        crc.append(zlib.crc32(read(a, b).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(run, TOKENS)
