"""Application tables under one published version.

A set of tables lives in a shared folder.  Every write goes to a new folder of
its own; which folders make up each table is said by one small manifest a
version.  Committing is a single rename of the next manifest into place, which
fails if somebody else put one there first.  So several tables change all at
once or not at all, readers always see one whole version, and of two writers
that started from the same version the second notices.

* ``create`` makes the tables only if they do not exist (A9).  A table may be
  bucketed on a column, so that joins and groupings on it need no exchange.
  One hot key makes one large bucket: the largest bucket is measured when a
  table is written, and an uneven table is read as plain files, which the
  adaptive skew handling can split.
* ``append`` gives rows without an ``id`` the next ones (A8).  An append that
  lost the race is renumbered behind the winner and committed again.
* ``transact`` replaces several tables by a function of the current version
  and computes it anew if the version moved on (H5).

What a crash leaves behind are folders that no manifest names; ``vacuum``
deletes them.  The folder must be on a file system whose rename does not
overwrite and is atomic (HDFS and its kin; the local one for tests).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators.changes import delete_users_cascade
from ..plans.ranking import numbered_within
from .files import with_defaults

#: the five application tables
APP_TABLES = {
    "users": S.USERS,
    "profiles": S.PROFILES,
    "user_texts": S.USER_TEXTS,
    "user_feedback": S.USER_FEEDBACK,
    "login_history": S.LOGIN_HISTORY,
}
#: files that each bucket is written in, by as many tasks
FILES_PER_BUCKET = 4
#: the tables hold each text twice
CODEC = "zstd"
#: a table whose largest bucket holds more than this many times the mean is
#: read as plain files
UNEVEN = 4.0


class Layout(NamedTuple):
    column: str
    buckets: int


def user_layouts(buckets: int) -> dict[str, Layout]:
    """All five tables bucketed alike on their user, for C1, C2 and D1."""
    return {t: Layout("id" if t == "users" else "user_id", buckets) for t in APP_TABLES}


class CommitConflict(RuntimeError):
    """The version moved on more often than an operation may be repeated."""


class Published:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        tables: dict[str, T.StructType] | None = None,
        layouts: dict[str, Layout] | None = None,
        attempts: int = 10,
    ):
        self.spark, self.tables, self.layouts, self.attempts = spark, tables or APP_TABLES, layouts or {}, attempts
        hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._path = hadoop.Path
        self._fs = hadoop.Path(root).getFileSystem(conf)
        qualified = self._fs.makeQualified(hadoop.Path(root))
        self._context = hadoop.FileContext.getFileContext(qualified.toUri(), conf)
        self.root = qualified.toString()

    # ---- versions ---------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.root}/_versions") if n.endswith(".json") and not n.startswith(".")]

    def version(self) -> int:
        """The published version; 0 if there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/_versions/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, changed: dict[str, dict]) -> bool:
        """Publish ``base`` with the changed tables; False if its successor
        exists already."""
        new = {"version": base["version"] + 1, "tables": base["tables"] | changed}
        temporary = self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(json.dumps(new).encode())
        out.close()
        mode = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(mode, 1)
        modes[0] = mode.NONE
        target = self._path(f"{self.root}/_versions/{new['version']:010d}.json")
        try:
            self._context.rename(temporary, target, modes)
        except Exception:
            if not self._fs.exists(target):
                raise
            return False
        finally:
            self._fs.delete(temporary, False)
        return True

    # ---- rows -------------------------------------------------------------

    def _catalog_name(self, folder: str) -> str:
        return "published_" + "_".join(folder.rstrip("/").rsplit("/", 2)[1:])

    def _attach(self, name: str, folder: str) -> DataFrame:
        """A folder as a bucketed catalog table of this session."""
        layout, table = self.layouts[name], self._catalog_name(folder)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.tables[name].fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"CLUSTERED BY (`{layout.column}`) INTO {layout.buckets} BUCKETS LOCATION '{folder}'"
        )
        return self.spark.table(table)

    def _write(self, name: str, rows: DataFrame) -> dict:
        """Rows into a new folder; what a manifest says about it."""
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows = with_defaults(rows, self.tables[name])
        layout = self.layouts.get(name)
        if not layout:
            rows.write.parquet(folder, compression=CODEC)
            return {"folder": folder, "even": True}
        key = "id" if "id" in rows.columns else layout.column
        bucket = F.pmod(F.hash(layout.column), F.lit(layout.buckets))
        dealt = rows.repartition(layout.buckets, bucket, F.pmod(F.xxhash64(key), F.lit(FILES_PER_BUCKET)))
        dealt.write.format("parquet").option("compression", CODEC).bucketBy(layout.buckets, layout.column).option("path", folder).saveAsTable(self._catalog_name(folder))
        sizes = self._plain(name, [folder]).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
        most, total = sizes.agg(F.max("n"), F.sum("n")).first()
        return {"folder": folder, "even": (most or 0) * layout.buckets <= UNEVEN * max(total or 0, layout.buckets)}

    def _plain(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.tables[name]).parquet(*folders)

    def read(self, name: str, manifest: dict | None = None, bucketed: bool | None = None) -> DataFrame:
        """One table of the published version (or of ``manifest``), by buckets
        if it has any and they are even."""
        parts = (manifest or self.manifest())["tables"][name]["parts"]
        if bucketed is None:
            bucketed = all(p["even"] for p in parts)
        if name not in self.layouts or not bucketed:
            return self._plain(name, [p["folder"] for p in parts])
        return reduce(DataFrame.unionByName, [self._attach(name, p["folder"]) for p in parts])

    def _next_id(self, rows: DataFrame) -> int:
        return (rows.agg(F.max("id")).first()[0] or 0) + 1 if "id" in rows.columns else 1

    # ---- operations ---------------------------------------------------------

    def create(self, first: dict[str, DataFrame] | None = None) -> bool:
        """The tables, empty or with their first rows, unless they exist;
        whether this call made them."""
        if self.version():
            return False
        entries = {}
        for name, schema in self.tables.items():
            rows = (first or {}).get(name)
            part = self._write(name, self.spark.createDataFrame([], schema) if rows is None else rows)
            entries[name] = {"parts": [part], "next_id": self._next_id(self._plain(name, [part["folder"]]))}
        return self._commit({"version": 0, "tables": {}}, entries)

    def append(self, name: str, rows: DataFrame) -> int:
        """Append rows; those without an ``id`` column are numbered on
        from the largest one.  Returns the version that holds them."""
        numbered = "id" in self.tables[name].fieldNames() and "id" not in rows.columns
        if numbered:  # numbered once from 1; where that begins is settled by the commit
            order = rows.withColumn("_seq", F.monotonically_increasing_id())
            staging = f"{self.root}/_staging/{uuid.uuid4().hex}"
            numbered_within(order, [], ["_seq"], "_nth").drop("_seq").write.parquet(staging)
            rows = self.spark.read.parquet(staging)
            n = rows.count()
        base = self.manifest()
        for _ in range(self.attempts):
            first = base["tables"][name]["next_id"]
            part = self._write(name, rows.withColumn("id", F.col("_nth") + (first - 1)).drop("_nth") if numbered else rows)
            then = first + n if numbered else max(first, self._next_id(self._plain(name, [part["folder"]])))
            while True:
                entry = base["tables"][name]
                changed = {name: {"parts": [*entry["parts"], part], "next_id": max(then, entry["next_id"])}}
                if self._commit(base, changed):
                    if numbered:
                        self._fs.delete(self._path(staging), True)
                    return base["version"] + 1
                base = self.manifest()
                if numbered and base["tables"][name]["next_id"] != first:
                    break  # another append took the ids: number these behind it
        raise CommitConflict(f"append to {name} lost {self.attempts} races")

    def transact(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
        """Replace tables by what ``change`` makes of the current version, all
        or none of them; computed anew if another commit came first."""
        for _ in range(self.attempts):
            base = self.manifest()
            frames = {name: self.read(name, base) for name in base["tables"]}
            written = {name: self._write(name, rows) for name, rows in change(frames).items()}
            changed = {name: base["tables"][name] | {"parts": [part]} for name, part in written.items()}
            for name, entry in changed.items():  # ids are never given twice
                entry["next_id"] = max(entry["next_id"], self._next_id(self._plain(name, [written[name]["folder"]])))
            if self._commit(base, changed):
                return base["version"] + 1
        raise CommitConflict(f"a change lost {self.attempts} races")

    def vacuum(self, keep: int = 2, min_age_s: float = 86_400.0) -> list[str]:
        """Delete the folders that none of the last ``keep`` manifests names
        and that are older than ``min_age_s`` (younger ones may belong to a
        write under way), and the manifests before those."""
        import time

        kept = sorted(self.versions())[-keep:]
        named = {p["folder"] for v in kept for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        for v in sorted(self.versions())[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_versions/{v:010d}.json"), False)
        gone, before = [], (time.time() - min_age_s) * 1000
        for name in [*self.tables, "_staging"]:
            for child in self._names(f"{self.root}/{name}"):
                folder = f"{self.root}/{name}/{child}"
                path = self._path(folder)
                if folder not in named and self._fs.getFileStatus(path).getModificationTime() <= before:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._catalog_name(folder)}")
                    self._fs.delete(path, True)
                    gone.append(folder)
        return gone


def delete_users(store: Published, chosen: Callable[[dict[str, DataFrame]], DataFrame]) -> int:
    """H5: delete the chosen users (a frame of ``id``, made from the current
    tables) and every row that refers to them, all or nothing."""
    return store.transact(lambda tables: delete_users_cascade(tables, chosen(tables)))
