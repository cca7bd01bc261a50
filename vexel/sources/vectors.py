"""Readers and writers of the common binary vector formats, as a Python data source.

    u8bin i8bin f32bin     <u32 n><u32 d>, then n * d values
    fvecs ivecs bvecs      per vector <i32 d>, then d values of 4, 4 or 1 bytes
    u64bin                 <u32 n><u32 1>, then n ids of 8 bytes
    parquet                a table with external_id and vector

All have fixed record lengths, so a file is cut into ranges of records and each is a task's work.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: suffix: (numpy type, Spark element, bytes before the first record, record header)
FORMATS = {
    "u8bin": ("<u1", "smallint", 8, 0),
    "i8bin": ("<i1", "tinyint", 8, 0),
    "f32bin": ("<f4", "float", 8, 0),
    "fvecs": ("<f4", "float", 0, 4),
    "ivecs": ("<i4", "int", 0, 4),
    "bvecs": ("<u1", "smallint", 0, 4),
    "u64bin": ("<u8", "bigint", 8, 0),
}
RANGE_BYTES = 64 << 20
BATCH_ROWS = 4096


def autodetect(uri: str) -> str:
    """The source type of an address, by its suffix."""
    suffix = uri.rstrip("/").rsplit(".", 1)[-1].lower()
    return suffix if suffix in FORMATS else "parquet"


def _open(uri: str):
    """(file, size) of an address on any file system that pyarrow knows; a plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return open(uri, "rb"), os.path.getsize(uri)
    from pyarrow import fs

    f, path = fs.FileSystem.from_uri(uri)
    return f.open_input_file(path), f.get_file_info(path).size


def _create(uri: str):
    """A new file at an address, as _open() takes it."""
    if "://" not in uri and not uri.startswith("file:"):
        return open(uri, "wb")
    from pyarrow import fs

    f, path = fs.FileSystem.from_uri(uri)
    return f.open_output_stream(path)


def file_metadata(uri: str, kind: str) -> tuple[int, int, str]:
    """(vectors, dimensions, element type) from a file's first bytes and length."""
    dtype, _, skip, head = FORMATS[kind]
    f, size = _open(uri)
    with f:
        first = f.read(8)
    if skip:
        if len(first) < 8:
            raise ValueError(f"{uri} has no header")
        n, d = struct.unpack("<II", first)
        if size < 8 + n * d * np.dtype(dtype).itemsize:
            raise ValueError(f"{uri} is shorter than its header says")
        return n, d, np.dtype(dtype).name
    if not size:
        return 0, 0, np.dtype(dtype).name
    d = struct.unpack("<i", first[:4])[0]
    record = head + d * np.dtype(dtype).itemsize
    if d < 1 or size % record:
        raise ValueError(f"{uri} is not made of records of {d} values")
    return size // record, d, np.dtype(dtype).name


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, uri: str, kind: str, range_bytes: int):
        self.uri, self.kind, self.range_bytes = uri, kind, range_bytes
        self.n, self.d, _ = file_metadata(uri, kind)

    def partitions(self):
        dtype, _, _, head = FORMATS[self.kind]
        step = max(1, self.range_bytes // max(1, head + self.d * np.dtype(dtype).itemsize))
        return [_Range(i, min(self.n, i + step)) for i in range(0, self.n, step)] or [_Range(0, 0)]

    def read(self, part):
        dtype, element, skip, head = FORMATS[self.kind]
        kinds = {"smallint": pa.int16(), "tinyint": pa.int8(), "float": pa.float32(), "int": pa.int32(), "bigint": pa.int64()}
        width = np.dtype(dtype).itemsize
        record = head + self.d * width
        f, _ = _open(self.uri)
        with f:
            f.seek(skip + part.start * record)
            for i in range(part.start, part.stop, BATCH_ROWS):
                n = min(BATCH_ROWS, part.stop - i)
                raw = np.frombuffer(f.read(n * record), np.uint8).reshape(n, record)
                if head and (np.ascontiguousarray(raw[:, :4]).view("<i4") != self.d).any():
                    raise ValueError(f"{self.uri} has vectors of different length")
                x = np.ascontiguousarray(raw[:, head:]).view(dtype)
                x = x.view(np.int64) if dtype == "<u8" else x
                flat = pa.array(x.ravel()).cast(kinds[element])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.d), flat)], ["external_id", "vector"])


class VectorFile(DataSource):
    """spark.read.format("vectors").option("type", "fvecs").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def _kind(self) -> str:
        return self.options.get("type") or autodetect(self.options["path"])

    def schema(self) -> str:
        return f"external_id bigint, vector array<{FORMATS[self._kind()][1]}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._kind(), int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_vectors(spark: SparkSession, uri: str, source_type: str | None = None, dimensions: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(external_id, vector) of a file or table; external_id is the position in a file. `dimensions` keeps the first so many."""
    kind = (source_type or autodetect(uri)).lower()
    if kind == "parquet":
        df = spark.read.parquet(uri)
        if "external_id" not in df.columns:
            raise ValueError(f"{uri} has no column external_id")
        df = df.select(F.col("external_id").cast("long").alias("external_id"), "vector")
    elif kind in FORMATS:
        spark.dataSource.register(VectorFile)
        df = spark.read.format("vectors").option("type", kind).option("rangeBytes", range_bytes).load(uri)
    else:
        raise ValueError(f"unknown source type {source_type!r}; known: {', '.join([*FORMATS, 'parquet'])}")
    return df if dimensions is None or kind == "parquet" else df.withColumn("vector", F.slice("vector", 1, dimensions))


def read_ids(spark: SparkSession, uri: str, source_type: str | None = None) -> DataFrame:
    """(pos, external_id): ids of a u64bin file by position, or of a table with these columns."""
    if (source_type or autodetect(uri)).lower() == "u64bin":
        return read_vectors(spark, uri, "u64bin").select(F.col("external_id").alias("pos"), F.col("vector")[0].alias("external_id"))
    return spark.read.parquet(uri).select("pos", "external_id")


def source_metadata(spark: SparkSession, uri: str, source_type: str | None = None) -> tuple[int, int, str]:
    """(vectors, dimensions, element type)."""
    kind = (source_type or autodetect(uri)).lower()
    if kind != "parquet":
        return file_metadata(uri, kind)
    df = spark.read.parquet(uri)
    n, d = df.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return n, d or 0, df.schema["vector"].dataType.elementType.simpleString()


def write_vectors(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Writes one file in the order of external_id, by way of the driver; for exchange and fixtures.

    Tasks turn runs of sorted vectors into bytes, the driver puts those of one partition after another, so it holds one partition's.
    """
    dtype, _, skip, head = FORMATS[kind or autodetect(path)]

    def encoded(batches):
        for b in batches:
            x = b.column(1)
            size = np.unique(np.diff(x.offsets.to_numpy()))
            if len(size) > 1:
                raise ValueError("vectors of unequal length")
            if not len(size):
                continue
            v = np.ascontiguousarray(np.asarray(x.flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1).astype(dtype))
            rows = v.view(np.uint8).reshape(b.num_rows, -1)
            if head:
                rows = np.hstack([np.tile(np.frombuffer(struct.pack("<i", int(size[0])), np.uint8), (b.num_rows, 1)), rows])
            yield pa.RecordBatch.from_arrays([pa.array([int(size[0])], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["d", "data"])

    own = df.select("external_id", "vector")
    n, d = own.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    with _create(path) as f:
        if skip:
            f.write(struct.pack("<II", n, d or 0))
        for r in own.orderBy("external_id").mapInArrow(encoded, "d int, data binary").toLocalIterator():
            if r.d != d:
                raise ValueError("vectors of unequal length")
            f.write(r.data)


def coo_to_vectors(df: DataFrame, row: str, col: str, value: str, dimensions: int) -> DataFrame:
    """Dense vectors of a sparse table, absent cells 0; of a cell given twice the greatest value counts. The width is given, not found."""
    cells = df.groupBy(row, col).agg(F.max(value).alias("v"))
    m = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col).cast("int"), F.col("v").cast("float")))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0).cast("float")))
    return m.select(F.col(row).cast("long").alias("external_id"), v.alias("vector"))


def blocks_to_vectors(df: DataFrame, vectors: str = "vectors", ids: str = "external_ids") -> DataFrame:
    """(external_id, vector) of rows that each hold many vectors end to end and their ids; the width is the number of elements by that of ids."""
    width = (F.size(vectors) / F.size(ids)).cast("int")
    rows = df.where(F.size(ids) > 0).select(F.posexplode(ids).alias("_i", "external_id"), F.col(vectors).alias("_v"), width.alias("_w"))
    return rows.select(F.col("external_id").cast("long").alias("external_id"), F.slice("_v", F.col("_i") * F.col("_w") + 1, F.col("_w")).alias("vector"))


def load_as_matrix(spark: SparkSession, uri: str, size: int | None = None, source_type: str | None = None) -> np.ndarray:
    """The first `size` vectors (default: all) as a NumPy matrix on the driver."""
    df = read_vectors(spark, uri, source_type)
    t = (df if size is None else df.orderBy("external_id").limit(size)).toArrow().sort_by("external_id")
    return np.array(t["vector"].to_pylist())
