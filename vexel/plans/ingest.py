"""Building an index version from vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import normalize
from ..functions.metrics import Metric, check_metric
from ..operators import graph, kmeans, pq
from ..sources import read_ids, read_vectors
from . import store as st
from .index import Index, create

MAX_PARTITIONS = 10_000
SAMPLES_PER_PARTITION = 100
SAMPLE_WORK = 1.024e13
ROWS_PER_FILE = 500_000


def auto_partitions(size: int) -> int:
    return max(1, min(MAX_PARTITIONS, math.isqrt(size)))


def auto_sample(size: int, dims: int, partitions: int) -> int:
    return int(min(size, SAMPLES_PER_PARTITION * partitions, max(1, SAMPLE_WORK / max(1, dims) / partitions)))


def _frame(spark: SparkSession, vectors, ids) -> DataFrame:
    if isinstance(vectors, DataFrame):
        return vectors.select(F.col("external_id").cast("long").alias("external_id"), "vector")
    v = np.asarray(vectors)
    if v.ndim != 2:
        raise ValueError("input_vectors must have two dimensions")
    ids = np.arange(len(v), dtype=np.uint64) if ids is None else np.asarray(ids, dtype=np.uint64)
    if len(ids) != len(v):
        raise ValueError("as many external_ids as vectors are needed")
    return spark.createDataFrame(pa.table({"external_id": ids.view(np.int64), "vector": pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))}))


def _check(a: dict) -> None:
    def one_of(*names):
        given = [n for n in names if a.get(n) is not None]
        if len(given) > 1:
            raise ValueError(f"{' and '.join(given)} can't be given together")

    one_of("input_vectors", "source_uri")
    one_of("external_ids", "external_ids_uri")
    one_of("training_input_vectors", "training_source_uri")
    one_of("centroids", "copy_centroids_uri")
    if a["input_vectors"] is None and a["source_uri"] is None and a["updates_uri"] is None:
        raise ValueError("input_vectors or source_uri is needed")
    if a["source_type"] and not a["source_uri"]:
        raise ValueError("source_type needs source_uri")
    if a["training_source_type"] and not a["training_source_uri"]:
        raise ValueError("training_source_type needs training_source_uri")
    if (a["copy_centroids_uri"] or a["centroids"] is not None) and (a["training_sample_size"] or a["training_source_uri"] or a["training_input_vectors"] is not None):
        raise ValueError("given centroids leave nothing to train")
    if a["copy_centroids_uri"] and not a["partitions"]:
        raise ValueError("copy_centroids_uri needs partitions")
    if a["training_sampling_policy"] not in ("FIRST_N", "RANDOM"):
        raise ValueError(f"unknown sampling policy {a['training_sampling_policy']!r}")
    if a["index_type"] not in ("IVF_FLAT", "IVF_PQ") and (a["partitions"] or a["training_sample_size"]):
        raise ValueError(f"{a['index_type']} is not trained on a sample")


def ingest(
    spark: SparkSession,
    index_type: str,
    index_uri: str,
    *,
    input_vectors=None,
    source_uri: str | None = None,
    source_type: str | None = None,
    external_ids=None,
    external_ids_uri: str | None = None,
    external_ids_type: str | None = None,
    updates_uri: str | None = None,
    index_timestamp: int | None = None,
    size: int | None = None,
    dimensions: int | None = None,
    partitions: int | None = None,
    num_subspaces: int | None = None,
    l_build: int = graph.L_BUILD,
    r_max_degree: int = graph.R_MAX_DEGREE,
    training_sampling_policy: str = "FIRST_N",
    copy_centroids_uri: str | None = None,
    centroids: DataFrame | None = None,
    training_sample_size: int | None = None,
    training_input_vectors=None,
    training_source_uri: str | None = None,
    training_source_type: str | None = None,
    storage_version: str = st.STORAGE_VERSION,
    distance_metric: Metric | int | str = Metric.SUM_OF_SQUARES,
    normalized: bool = False,
    seed: int = 0,
    max_iter: int = 10,
    shards: int | None = None,
) -> Index:
    """Builds a version of the index at index_uri, creating it if it is not there, and opens it.

    Vectors come as a DataFrame (external_id, vector), a matrix with external_ids, or a source;
    rows with a null id or vector are left out, of repeated ids the least vector stays. `size` takes the first so many positions. With COSINE,
    IVF_FLAT stores vectors at length 1 (normalized: they are already). index_timestamp must be after the last version's.
    """
    _check(dict(locals()))
    metric = check_metric(index_type, distance_metric)
    if updates_uri is not None and input_vectors is None and source_uri is None:
        df = spark.createDataFrame([], "external_id long, vector array<float>")
    elif source_uri is not None:
        df = read_vectors(spark, source_uri, source_type, dimensions)
        if external_ids_uri is not None:
            own = read_ids(spark, external_ids_uri, external_ids_type).withColumnRenamed("external_id", "_id")
            df = df.join(own, df["external_id"] == own["pos"]).select(F.col("_id").alias("external_id"), "vector")
    else:
        df = _frame(spark, input_vectors, external_ids)
    if size is not None:
        df = kmeans.sample(df, size, "FIRST_N") if isinstance(input_vectors, DataFrame) or external_ids is not None else df.where(F.col("external_id") < size)
    df = df.where("external_id is not null and vector is not null")
    if updates_uri is not None:
        u = st.latest(spark.read.schema(st.UPDATES).parquet(updates_uri))
        df = df.join(u.select("external_id"), "external_id", "left_anti").unionByName(u.where("size(vector) > 0").select("external_id", "vector"))
    stored = df.schema["vector"].dataType.elementType.simpleString()
    df = df.withColumn("vector", F.col("vector").cast("array<float>"))
    # Only ids are shuffled to see whether any is repeated; vectors only if so.
    if not df.groupBy("external_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        df = df.groupBy("external_id").agg(F.min("vector").alias("vector"))
    n, dims = df.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    s = st.Store(spark, index_uri)
    dims = dimensions or dims or (s.load()["dimensions"] if s.exists() else None)
    if dims is None:
        raise ValueError("dimensions is needed for an empty input")
    if not df.where(F.size("vector") != dims).isEmpty():
        raise ValueError(f"all vectors must have {dims} dimensions")
    params = {"num_subspaces": num_subspaces} if index_type == "IVF_PQ" else {"l_build": l_build, "r_max_degree": r_max_degree} if index_type == "VAMANA" else {}
    if not s.exists():
        create(spark, index_uri, index_type, dims, {"short": "uint8", "tinyint": "int8", "smallint": "uint8"}.get(stored, "float32"), metric, storage_version, **params)
    meta = s.load()
    if meta["index_type"] != index_type or meta["dimensions"] != dims or meta["distance_metric"] != int(metric):
        raise ValueError("the index there has another type, metric or number of dimensions")
    history = meta["ingestion_timestamps"]
    ts = st.now_ms() if index_timestamp is None else index_timestamp
    if history and ts <= history[-1]:
        raise ValueError(f"timestamp {ts} is not after the last ingestion, {history[-1]}")

    if index_type == "IVF_FLAT" and metric is Metric.COSINE and not normalized:
        df = df.withColumn("vector", normalize("vector").cast("array<float>"))
    parts = 0
    if index_type == "FLAT":
        s.write(df, "vectors", ts)
    elif index_type == "VAMANA":
        s.write(df, "vectors", ts)
        g = graph.build_vamana(s.read("vectors", ts), l_build, r_max_degree, metric=metric, shards=shards or max(1, -(-n // graph.SHARD_ROWS)))
        s.write(g, "graph", ts)
    else:
        parts = partitions or auto_partitions(n)
        if copy_centroids_uri is not None:
            centroids = spark.read.parquet(copy_centroids_uri).where(F.col("part_id") < parts)
        if centroids is None:
            train = df
            if training_input_vectors is not None:
                train = _frame(spark, training_input_vectors, None)
            elif training_source_uri is not None:
                train = read_vectors(spark, training_source_uri, training_source_type, dims)
            if metric is Metric.COSINE and train is not df:
                train = train.withColumn("vector", normalize("vector").cast("array<float>"))
            rows = training_sample_size or auto_sample(n, dims, parts)
            centroids = kmeans.kmeans_fit(train, parts, "random", max_iter, 1e-4, seed, rows, policy=training_sampling_policy) if n or train is not df else kmeans.centroid_table(spark, np.zeros((parts, dims)))
        s.write(centroids, "centroids", ts)
        centroids = s.read("centroids", ts)
        parts = centroids.count()
        v = kmeans.assign(df, centroids)
        if index_type == "IVF_PQ":
            s.write(pq.train_pq(df, num_subspaces, max_iter=max_iter, seed=seed), "codebook", ts)
            v = pq.encode(v, s.read("codebook", ts)) if n else v.withColumn("codes", F.lit(None).cast("array<short>"))
        # One file a partition, or one for every ROWS_PER_FILE vectors of larger ones.
        salt = F.pmod(F.xxhash64("external_id"), F.lit(1 + n // (parts * ROWS_PER_FILE)))
        s.write(v.repartition("part_id", salt), "vectors", ts, by="part_id")
    meta = s.load()
    later = not s.updates(ts + 1).isEmpty()
    s.save(meta | {"ingestion_timestamps": [*history, ts], "base_sizes": [*meta["base_sizes"], n], "partition_history": [*meta["partition_history"], parts], "has_updates": later or meta["has_updates"]})
    return Index(spark, index_uri)
