"""Opening and querying an index, its updates, versions and maintenance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import normalize
from ..functions.metrics import MAX_FLOAT32, NO_ID, Metric, check_metric
from ..operators import graph, ivf, knn, pq, topk
from . import store as st

QUERY = "query_id long, vector array<float>"


def create(spark: SparkSession, uri: str, index_type: str, dimensions: int, vector_type: str = "float32", metric: Metric | int | str = Metric.SUM_OF_SQUARES, storage_version: str = st.STORAGE_VERSION, **params) -> Index:
    """An empty index. ValueError for an unknown type, a metric or storage version it doesn't take, or one that is already there."""
    m = check_metric(index_type, metric)
    if storage_version not in st.STORAGE_VERSIONS:
        raise ValueError(f"unknown storage version {storage_version}")
    if index_type in ("VAMANA", "IVF_PQ") and storage_version != "0.3":
        raise ValueError(f"{index_type} needs storage version 0.3")
    if index_type == "IVF_PQ":
        pq.check_subspaces(dimensions, params.get("num_subspaces") or 0)
    s = st.Store(spark, uri)
    if s.exists():
        raise ValueError(f"there is an index at {uri}")
    s.save({"dataset_type": "vector_search", "index_type": index_type, "dimensions": dimensions, "dtype": vector_type, "distance_metric": int(m), "storage_version": storage_version, "ingestion_timestamps": [], "base_sizes": [], "partition_history": [], "has_updates": False, "params": params})
    return Index(spark, uri)


def open_index(spark: SparkSession, uri: str, timestamp=None) -> Index:
    """The index as of a timestamp (None: now; a number; or a pair), see store.resolve()."""
    return Index(spark, uri, timestamp)


def delete_index(spark: SparkSession, uri: str) -> None:
    """Deletes the index's directory; nothing happens if there is none."""
    st.Files(spark).delete(uri)


class Index:
    """A view of an index. Queries are lazy DataFrames (query_id, rank, external_id, distance)."""

    def __init__(self, spark: SparkSession, uri: str, timestamp=None):
        self.spark, self.uri, self.timestamp = spark, uri, timestamp
        self.store = st.Store(spark, uri)
        self.refresh()

    def refresh(self) -> None:
        self.meta = self.store.load()
        self.index_type, self.dimensions = self.meta["index_type"], self.meta["dimensions"]
        self.metric, self.params = Metric(self.meta["distance_metric"]), self.meta["params"]
        self.version, self.low, self.high = st.resolve(self.meta["ingestion_timestamps"], self.timestamp)

    # What is in view

    @property
    def normalized(self) -> bool:
        return self.index_type == "IVF_FLAT" and self.metric is Metric.COSINE

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "external_id long, vector array<float>, part_id int, codes array<short>")

    def base(self) -> DataFrame:
        """The vectors of the version in view, with part_id and codes where the type has them."""
        return self._empty() if self.version is None else self.store.read("vectors", self.version)

    def updates(self) -> DataFrame:
        """(external_id, vector): the last entry in the window of each id that has one."""
        return st.latest(self.store.updates(self.low, self.high))

    @property
    def has_updates(self) -> bool:
        return self.meta["has_updates"] and self.low <= self.high and not self.store.updates(self.low, self.high).isEmpty()

    def vectors(self) -> DataFrame:
        """(external_id, vector) in view: the base without touched ids, and their last live state."""
        if not self.has_updates:
            return self.base().select("external_id", "vector")
        return st.apply_updates(self.base(), self.store.updates(self.low, self.high))

    @property
    def size(self) -> int:
        if self.version is None:
            return 0
        return self.meta["base_sizes"][self.meta["ingestion_timestamps"].index(self.version)]

    @property
    def centroids(self) -> DataFrame:
        return self.store.read("centroids", self.version)

    # Queries

    def _queries(self, queries) -> DataFrame:
        if isinstance(queries, np.ndarray):
            if queries.ndim != 2:
                raise ValueError("queries must have two dimensions")
            if queries.dtype != np.float32:
                raise TypeError("queries must be float32")
            if queries.shape[1] != self.dimensions:
                raise ValueError(f"queries have {queries.shape[1]} dimensions, the index {self.dimensions}")
            t = pa.table({"query_id": np.arange(len(queries)), "vector": pa.array(list(queries), pa.list_(pa.float32()))})
            q = self.spark.createDataFrame(t)
        else:
            kind = queries.schema["vector"].dataType.simpleString()
            if kind != "array<float>":
                raise TypeError(f"query vectors must be array<float>, not {kind}")
            wrong = f"size(vector) <> {self.dimensions}"
            if not queries.where(wrong).isEmpty():
                raise ValueError(f"queries must have {self.dimensions} dimensions")
            q = queries.select("query_id", "vector").where("vector is not null")
        return q.withColumn("vector", normalize("vector").cast("array<float>")) if self.normalized else q

    def query(self, queries, k: int, nprobe: int | None = None, k_factor: float = 1.0, l_search: int | None = None, pad: bool = False, ids: DataFrame | None = None) -> DataFrame:
        """The k nearest of each query: a float32 matrix (query_id is the row) or a DataFrame (query_id, vector array<float>).

        nprobe: partitions looked at (IVF_FLAT 1, IVF_PQ 100 by default). k_factor: candidates
        ranked anew by exact distance (IVF_PQ). l_search: width of the walk (VAMANA, 100). ids:
        (external_id) of the vectors that may be found; applied before the search. pad: exactly k rows a query.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        q = self._queries(queries)
        if ids is not None or (self.index_type == "VAMANA" and self.version is None):
            allowed = self.vectors() if ids is None else self.vectors().join(ids.select("external_id").distinct(), "external_id", "left_semi")
            found = knn.knn(allowed, q, k, self.metric)
        elif self.version is None:
            found = knn.knn(self.vectors(), q, k, self.metric)
        else:
            touched = self.updates() if self.has_updates else None
            found = self._base_query(q, k, nprobe, k_factor, l_search, touched)
            if touched is not None:
                new = knn.knn(touched.where("size(vector) > 0"), q, k, self.metric)
                found = topk.merge_top_k([found, new], k, self.metric)
        return topk.pad_missing(found, q, k) if pad else found

    def _base_query(self, q: DataFrame, k: int, nprobe: int | None, k_factor: float, l_search: int | None, touched: DataFrame | None) -> DataFrame:
        if self.index_type == "VAMANA":
            g = self.store.read("graph", self.version)
            return graph.vamana_query(g, q, k, l_search or graph.L_SEARCH, self.metric, None if touched is None else touched.select("external_id"))
        base = self.base()
        if touched is not None:
            base = base.join(touched.select("external_id"), "external_id", "left_anti")
        if self.index_type == "FLAT":
            return knn.knn(base, q, k, self.metric)
        if self.index_type == "IVF_FLAT":
            return ivf.ivf_query(base, self.centroids, q, k, nprobe or 1, self.metric)
        return pq.ivf_pq_query(base, self.centroids, self.store.read("codebook", self.version), q, k, nprobe or 100, k_factor, self.metric)

    def query_matrix(self, queries: np.ndarray, k: int, **options) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids), queries x k; missing results are the greatest float32 and the greatest uint64."""
        t = self.query(queries, k, **options).toArrow()
        d, i = np.full((len(queries), k), MAX_FLOAT32), np.full((len(queries), k), NO_ID, np.int64)
        at = (t["query_id"].to_numpy(), t["rank"].to_numpy() - 1)
        d[at], i[at] = t["distance"].to_numpy(), t["external_id"].to_numpy()
        return d.astype(np.float32), i.view(np.uint64)

    # Updates

    def _guard(self, timestamp: int | None) -> int:
        if self.meta["storage_version"] != "0.3" and timestamp is not None:
            raise ValueError("only storage version 0.3 has timestamps")
        ts = st.now_ms() if timestamp is None else timestamp
        if self.meta["ingestion_timestamps"] and ts <= self.meta["ingestion_timestamps"][-1]:
            raise ValueError(f"timestamp {ts} is not after the last ingestion, {self.meta['ingestion_timestamps'][-1]}")
        return ts

    def _flag(self) -> None:
        if not self.meta["has_updates"]:
            self.store.save(self.store.load() | {"has_updates": True})
        self.refresh()

    def update_batch(self, vectors: DataFrame, timestamp: int | None = None) -> None:
        """Inserts or replaces (external_id, vector), as of the timestamp (default: now)."""
        ts = self._guard(timestamp)
        if not vectors.where(f"vector is not null and size(vector) <> {self.dimensions}").isEmpty():
            raise ValueError(f"vectors must have {self.dimensions} dimensions")
        v = vectors.select(F.col("external_id").cast("long").alias("external_id"), "vector").where("external_id is not null and vector is not null")
        v = v.withColumn("vector", normalize("vector").cast("array<float>")) if self.normalized else v
        self.store.append_updates(v.withColumn("ts", F.lit(ts)))
        self._flag()

    def update(self, external_id: int, vector, timestamp: int | None = None) -> None:
        self.update_batch(self.spark.createDataFrame([(_signed(external_id), [float(x) for x in vector])], "external_id long, vector array<float>"), timestamp)

    def delete_batch(self, ids: DataFrame, timestamp: int | None = None) -> None:
        """Deletes the ids (external_id), as of the timestamp."""
        ts = self._guard(timestamp)
        self.store.append_updates(ids.select(F.col("external_id").cast("long").alias("external_id"), F.array().cast("array<float>").alias("vector"), F.lit(ts).alias("ts")).where("external_id is not null"))
        self._flag()

    def delete(self, external_id: int, timestamp: int | None = None) -> None:
        self.delete_batch(self.spark.createDataFrame([(_signed(external_id),)], "external_id long"), timestamp)

    # Maintenance

    def consolidate_updates(self, retrain_index: bool = False, **options) -> Index:
        """A new version with the updates worked in, one after the latest of both; IVF_FLAT keeps its centroids unless retrained."""
        from .ingest import ingest

        last = self.store.updates(self.low, self.high).agg(F.max("ts")).first()[0] or 0
        ts = max(last, self.version or 0) + 1
        keep = {}
        if self.index_type == "IVF_FLAT" and not retrain_index and self.version is not None:
            if options.get("partitions") not in (None, self.meta["partition_history"][-1]):
                raise ValueError("the number of partitions can only change with retrain_index=True")
            keep["centroids"] = self.centroids
        ingest(self.spark, self.index_type, self.uri, input_vectors=self.vectors(), index_timestamp=ts, distance_metric=self.metric, normalized=True, **(self.params | keep | options))
        self.timestamp = None
        self.refresh()
        return self

    def vacuum(self) -> None:
        """Drops update entries and directories that no version in the history needs any more."""
        self.store.compact_updates()
        self.store.drop_orphans()
        known = {f"v={t}" for t in self.meta["ingestion_timestamps"]}
        for name in ("vectors", "centroids", "codebook", "graph"):
            for v in self.store.files.names(f"{self.store.uri}/{name}"):
                if v not in known:
                    self.store.files.delete(f"{self.store.uri}/{name}/{v}")

    def clear_history(self, timestamp: int) -> None:
        """Forgets versions and updates up to the timestamp."""
        meta = self.store.load()
        gone = [t for t in meta["ingestion_timestamps"] if t <= timestamp]
        keep = [i for i, t in enumerate(meta["ingestion_timestamps"]) if t > timestamp]
        for name in ("ingestion_timestamps", "base_sizes", "partition_history"):
            meta[name] = [meta[name][i] for i in keep if i < len(meta[name])]
        left = self.store.updates(timestamp + 1)
        meta["has_updates"] = not left.isEmpty()
        self.store.rewrite_updates(left, meta)
        for t in gone:
            self.store.drop_version(t)
        self.refresh()


def _signed(i: int) -> int:
    """A 64-bit id as the long with the same bits."""
    return i - (1 << 64) if i >= 1 << 63 else i
