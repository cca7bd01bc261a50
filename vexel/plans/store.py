"""An index's directory: Parquet tables per version and one small description file.

    <uri>/_index.json                 what versions there are; replaced by a rename
    <uri>/<table>/v=<timestamp>/      vectors, centroids, codebook, graph of a version
    <uri>/updates/                    append-only (external_id, vector, ts); an empty vector deletes
    <uri>/object_metadata/            attributes of an object index

Readers trust only the description, so a version is there once it is named. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORAGE_VERSION = "0.3"
STORAGE_VERSIONS = ("0.1", "0.2", "0.3")
UPDATES = T.StructType([T.StructField("external_id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("ts", T.LongType())])
MAX_TS = (1 << 63) - 1
#: Update files beyond which they are rewritten as one.
COMPACT_FILES = 10


def now_ms() -> int:
    return int(time.time() * 1000)


class Files:
    """The few file operations needed, through Hadoop's file systems, so that any of their addresses will do."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        temp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(temp, p):  # a file system that doesn't rename onto a file
            fs.delete(p, False)
            if not fs.rename(temp, p):
                raise OSError(f"can't replace {path}")


class Store:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri, self.files = spark, uri.rstrip("/"), Files(spark)

    @property
    def _meta(self) -> str:
        return f"{self.uri}/_index.json"

    def exists(self) -> bool:
        return self.files.exists(self._meta)

    def load(self) -> dict:
        if not self.exists():
            raise FileNotFoundError(f"no index at {self.uri}")
        meta = json.loads(self.files.read(self._meta))
        if meta["storage_version"] not in STORAGE_VERSIONS:
            raise ValueError(f"unknown storage version {meta['storage_version']}")
        return meta

    def save(self, meta: dict) -> None:
        self.files.replace(self._meta, json.dumps(meta, indent=1, sort_keys=True))

    def path(self, name: str, version: int) -> str:
        return f"{self.uri}/{name}/v={version}"

    def write(self, df: DataFrame, name: str, version: int, by: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(self.path(name, version))

    def read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(self.path(name, version))

    def drop_version(self, version: int) -> None:
        for name in ("vectors", "centroids", "codebook", "graph"):
            self.files.delete(self.path(name, version))

    def _log(self) -> str:
        """The directory of the update log: the description file names it, so that a new log replaces the old one when that file does."""
        return f"{self.uri}/{self.load().get('updates', 'updates') if self.exists() else 'updates'}"

    def updates(self, low: int = 0, high: int = MAX_TS) -> DataFrame:
        """The log's entries with low <= ts <= high."""
        path = self._log()
        if not any(n.endswith(".parquet") for n in self.files.names(path)):
            return self.spark.createDataFrame([], UPDATES)
        return self.spark.read.schema(UPDATES).parquet(path).where(F.col("ts").between(low, high))

    def append_updates(self, df: DataFrame, path: str | None = None) -> None:
        df.select("external_id", F.col("vector").cast("array<float>").alias("vector"), F.col("ts").cast("long").alias("ts")).write.mode("append").parquet(path or self._log())

    def compact_updates(self) -> None:
        """Rewrites the log into fewer files if it has more than COMPACT_FILES."""
        old = [n for n in self.files.names(self._log()) if n.endswith(".parquet")]
        if len(old) > COMPACT_FILES:
            self.rewrite_updates(self.updates().repartition(1 + len(old) // 1000))

    def rewrite_updates(self, df: DataFrame, meta: dict | None = None) -> None:
        """Replaces the log by df and the description by meta (default: as it is).

        The new log is written beside the old one, then the description file, which names it, is replaced, and only then the
        old log goes: whatever is interrupted, one whole log is in force.
        """
        old, name = self._log(), f"updates-{uuid.uuid4().hex}"
        self.append_updates(df, f"{self.uri}/{name}")
        self.save((meta or self.load()) | {"updates": name})
        self.files.delete(old)

    def drop_orphans(self) -> None:
        """Deletes logs that an interrupted rewrite has left."""
        own = self._log().rsplit("/", 1)[-1]
        for n in self.files.names(self.uri):
            if n != own and (n == "updates" or n.startswith("updates-")):
                self.files.delete(f"{self.uri}/{n}")


def resolve(history: list[int], timestamp) -> tuple[int | None, int, int]:
    """(base version or None, first and last update timestamp) of a view in time; the window is empty if first > last.

    None is the newest state; a number the state at that time; (start, end) what was written
    between them, with the first version as base if it falls within.
    """
    nothing = (None, 1, 0)
    if timestamp is None:
        return (history[-1], history[-1] + 1, MAX_TS) if history else (None, 0, MAX_TS)
    if isinstance(timestamp, bool) or not isinstance(timestamp, (int, tuple, list)):
        raise TypeError("timestamp must be None, a number or a pair")
    if isinstance(timestamp, int):
        own = [t for t in history if t <= timestamp]
        return (own[-1], own[-1] + 1, timestamp) if own else nothing
    if len(timestamp) != 2:
        raise ValueError("a range of timestamps is a pair")
    start, end = timestamp[0] or 0, MAX_TS if timestamp[1] is None else timestamp[1]
    if not history or start > history[0]:
        return (None, start, end)
    return (history[0], history[0] + 1, end) if end >= history[0] else nothing


def latest(updates: DataFrame) -> DataFrame:
    """(external_id, vector): each id's last entry; of two with one timestamp the one with more elements (a vector before a deletion)."""
    return updates.groupBy("external_id").agg(F.max_by("vector", F.struct("ts", F.size("vector"), "vector")).alias("vector"))


def apply_updates(base: DataFrame, updates: DataFrame) -> DataFrame:
    """(external_id, vector): base without the ids that updates touch, and their last live state."""
    last = latest(updates)
    return base.select("external_id", "vector").join(last.select("external_id"), "external_id", "left_anti").unionByName(last.where("size(vector) > 0"))
