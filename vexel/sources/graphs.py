"""Import of a Vamana graph from the two binary files in which such in-memory graphs are commonly exchanged.

    graph   <u64 file size><u32 max degree><u32 medoid><u64 frozen points>, then per node <u32 n> and n ids of 4 bytes
    vectors <u32 n><u32 d>, then n * d float32 (the f32bin format)
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import sum_of_squares
from .vectors import _open, read_vectors


def parse_graph(raw: bytes) -> tuple[list[np.ndarray], int]:
    """(neighbours of each node, medoid). ValueError if the sizes don't fit or an id is no node."""
    if len(raw) < 24:
        raise ValueError("no graph header")
    size, _, medoid, _ = struct.unpack("<QIIQ", raw[:24])
    if size != len(raw) or size % 4:
        raise ValueError(f"the header says {size} bytes, there are {len(raw)}")
    words = np.frombuffer(raw, "<u4", offset=24)
    nbrs, at = [], 0
    while at < len(words):
        n = int(words[at])
        if at + 1 + n > len(words):
            raise ValueError("a node's list is cut short")
        nbrs.append(words[at + 1 : at + 1 + n].astype(np.int64))
        at += 1 + n
    if any((x >= len(nbrs)).any() for x in nbrs) or (nbrs and medoid >= len(nbrs)):
        raise ValueError("an id that is no node")
    return nbrs, medoid


def read_graph(spark: SparkSession, path: str, data_path: str | None = None) -> DataFrame:
    """(src, dst), with data_path also score, the sum of squares of the two vectors. The file is parsed on the driver: node lists have no fixed length."""
    f, _ = _open(path)
    with f:
        nbrs, _ = parse_graph(f.read())
    src = np.repeat(np.arange(len(nbrs)), [len(x) for x in nbrs])
    dst = np.concatenate([*nbrs, np.zeros(0, np.int64)])
    e = spark.createDataFrame(pa.table({"src": src.astype(np.int64), "dst": dst}))
    if data_path is None:
        return e
    v = read_vectors(spark, data_path, "f32bin")
    return e.join(v.toDF("src", "_a"), "src").join(v.toDF("dst", "_b"), "dst").select("src", "dst", sum_of_squares("_a", "_b").alias("score"))


def import_vamana(spark: SparkSession, path: str, data_path: str | None = None) -> DataFrame:
    """The graph table that graph.vamana_query() takes; vectors come from data_path, by default path + '.data'."""
    f, _ = _open(path)
    with f:
        nbrs, medoid = parse_graph(f.read())
    g = spark.createDataFrame(pa.table({"external_id": np.arange(len(nbrs)), "nbrs": pa.array(nbrs, pa.list_(pa.int64()))}))
    v = read_vectors(spark, data_path or f"{path}.data", "f32bin")
    return v.join(g, "external_id").select(F.lit(0).alias("shard"), "external_id", "vector", "nbrs", (F.col("external_id") == medoid).alias("start"))
