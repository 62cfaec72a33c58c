"""Incremental state: which files changed since the last snapshot, and the next snapshot.

A snapshot is a table of rows by ``path`` with ``size`` and ``mtime_ns`` (or a content hash). It
is written under a version of its own and then named by a pointer file, which is replaced in one
step, so that a reader sees one snapshot or the other at any time. The snapshot before stays for
those that still read it, and goes with the next. A snapshot that can't be read is no snapshot.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1
SIGNATURE = ("size", "mtime_ns")


def by(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def _same(new: DataFrame, old: DataFrame, signature) -> DataFrame:
    keys = ["path", *signature]
    marked = old.select(*[F.col(k).alias(f"__{k}") for k in keys]).dropDuplicates(["__path"])
    on = F.lit(True)
    for k in keys:
        on = on & (new[k] == F.col(f"__{k}") if k == "path" else new[k].eqNullSafe(F.col(f"__{k}")))
    return marked, on


def hits(new: DataFrame, old: DataFrame, signature=SIGNATURE) -> DataFrame:
    """Rows of the old snapshot whose file is unchanged."""
    current, on = _same(old, new, signature)
    return old.join(current, on, "left_semi")


def misses(new: DataFrame, old: DataFrame, signature=SIGNATURE) -> DataFrame:
    """Files that are new or changed."""
    known, on = _same(new, old, signature)
    return new.join(known, on, "left_anti")


def deleted(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of the old snapshot whose file is gone."""
    return old.join(new.select("path").distinct(), "path", "left_anti")


def merged(new: DataFrame, old: DataFrame, parse: Callable[[DataFrame], DataFrame], signature=SIGNATURE) -> DataFrame:
    """The next snapshot: unchanged rows as they were, the others parsed."""
    return hits(new, old, signature).unionByName(parse(misses(new, old, signature)), allowMissingColumns=True)


class Store:
    """Versioned snapshots in a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(conf)

    def _pointer(self) -> dict | None:
        at = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(at):
            return None
        try:
            found = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/CURRENT", wholetext=True).collect()))
        except ValueError:
            return None
        return found if isinstance(found, dict) and found.get("version") == VERSION else None

    def load(self, filters: dict | None = None) -> DataFrame:
        """The current snapshot; empty if there is none, it is broken, or it was made with other filters."""
        at = self._pointer()
        empty = self.spark.createDataFrame([], self.schema)
        if not at or at.get("filter") != (filters or {}):
            return empty
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{at['data']}")
        except AnalysisException:
            return empty

    def save(self, rows: DataFrame, filters: dict | None = None) -> DataFrame:
        """Write a snapshot, then point to it, then drop the last but one."""
        before = self._pointer() or {}
        name = f"snapshot-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.folder}/{name}")
        part = self._path(f"{self.folder}/.CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"version": VERSION, "filter": filters or {}, "data": name, "before": before.get("data")}).encode()))
        out.close()
        self._replace(part, self._path(f"{self.folder}/CURRENT"))
        if before.get("before"):
            self._fs.delete(self._path(f"{self.folder}/{before['before']}"), True)
        return self.load(filters)

    def _replace(self, part, at) -> None:
        gateway, fs = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm.org.apache.hadoop.fs
        rename = getattr(fs, "Options$Rename")
        over = gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(part), self._fs.makeQualified(at), over)

    def known_paths(self, filters: dict | None = None) -> DataFrame:
        return self.load(filters).select("path")

    def remove(self, paths: DataFrame, filters: dict | None = None) -> DataFrame:
        """Drop paths from the snapshot; all other rows keep what they hold."""
        return self.save(self.load(filters).join(paths.select("path").distinct(), "path", "left_anti"), filters)

    def is_cached(self, files: DataFrame, signature=("content_sha256",), filters: dict | None = None) -> DataFrame:
        """(path, cached): whether each file is in the snapshot with an equal signature."""
        known, on = _same(files, self.load(filters), signature)
        return files.join(known, on, "left").select(files["path"], F.col("__path").isNotNull().alias("cached"))

    def update(self, files: DataFrame, parse: Callable[[DataFrame], DataFrame], signature=SIGNATURE, filters: dict | None = None) -> DataFrame:
        """Parse what changed and save the next snapshot."""
        return self.save(merged(files, self.load(filters), parse, signature), filters)

    def follow(self, stream: DataFrame, parse: Callable[[DataFrame], DataFrame], checkpoint: str, signature=SIGNATURE):
        """A streaming query that brings each batch of files into the snapshot; nothing is deleted."""

        def batch(files: DataFrame, _: int) -> None:
            old = self.load()
            rest = old.join(files.select("path").distinct(), "path", "left_anti")
            self.save(rest.unionByName(merged(files, old, parse, signature), allowMissingColumns=True))

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
