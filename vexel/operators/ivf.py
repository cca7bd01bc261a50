"""Inverted-file search: only the partitions of the nearest centroids are looked at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as kn
from ..functions.metrics import Metric, as_metric
from .kmeans import centroid_matrix
from .knn import _SCORED, BLOCK, BROADCAST_BYTES, _batches, collect_queries, is_small, knn, meet, running_top_k
from .topk import top_k


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, part_id, rank): the nprobe nearest centroids of each query, always by sum of squares."""
    c = centroids.select(F.col("part_id").cast("long").alias("external_id"), F.col("centroid").alias("vector"))
    return knn(c, queries, nprobe).select("query_id", F.col("external_id").cast("int").alias("part_id"), "rank")


def active_partitions(probes: DataFrame) -> DataFrame:
    """(part_id, queries): the partitions that any query looks at, and how many do."""
    return probes.groupBy("part_id").agg(F.count_distinct("query_id").alias("queries"))


def ivf_query(base: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int = 1, metric: Metric | int | str = Metric.SUM_OF_SQUARES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k nearest of base (external_id, vector, part_id) among the nprobe partitions nearest to each query.

    Few queries: their partitions are known before the scan, which reads no others (base
    is stored by part_id), and the top-k is kept while scanning. Else: blocks of queries with near partitions meet the blocks of the partitions they probe.
    """
    m = as_metric(metric)
    c = centroid_matrix(centroids)
    if not is_small(queries, broadcast_bytes, k):
        return top_k(block_probe(base.select("external_id", "vector", "part_id"), c, queries, k, nprobe, m), k, m)
    qid, q = collect_queries(queries)
    by = probed_by(q, c, nprobe)
    shared = base.sparkSession.sparkContext.broadcast((qid, q, by))

    def run(batches):
        qid, q, by = shared.value

        def score(b, held):
            x, ids, part = kn.matrix(b.column(1)), b.column(0).to_numpy(), b.column(2).to_numpy()
            for p, at, near, rows in probing(part, by, held):
                near.add(x[at], ids[at], rows)

        return running_top_k(batches, m, k, qid, q, score)

    near = base.where(F.col("part_id").isin(sorted(by))) if len(by) < len(c) else base
    return top_k(near.select("external_id", "vector", "part_id").mapInArrow(run, _SCORED), k, m)


def probed_by(q: np.ndarray, c: np.ndarray, nprobe: int) -> dict[int, np.ndarray]:
    """Of each partition the rows of q that probe it."""
    probes = nearest_parts(q, c, nprobe)
    row = np.repeat(np.arange(len(probes)), probes.shape[1])
    order = np.argsort(probes.ravel(), kind="stable")
    parts, first = np.unique(probes.ravel()[order], return_index=True)
    return dict(zip(parts.tolist(), np.split(row[order], first[1:]))) if len(parts) else {}


def nearest_parts(q: np.ndarray, c: np.ndarray, nprobe: int) -> np.ndarray:
    """len(q) x nprobe: the nearest rows of c of each of q, the nearest first."""
    n, out = min(nprobe, len(c)), [np.zeros((0, min(nprobe, len(c))), np.int32)]
    for s in range(0, len(q), BLOCK):
        near = kn.Nearest(Metric.SUM_OF_SQUARES, q[s : s + BLOCK], n)
        near.add(c, np.arange(len(c)))
        out.append(near.result()[1].reshape(-1, n).astype(np.int32))
    return np.concatenate(out)


def probing(part: np.ndarray, by: dict[int, np.ndarray], held):
    """(partition, rows of the batch, running top-k, its rows) of all that meet in a batch, BLOCK rows at a time."""
    for p in np.unique(part).tolist():
        if p in by:
            rows = np.flatnonzero(part == p)
            for near, s, e in held:
                lo, hi = np.searchsorted(by[p], [s, e])
                if hi > lo:
                    for a in range(0, len(rows), BLOCK):
                        yield p, rows[a : a + BLOCK], near, by[p][lo:hi] - s


def with_probes(queries: DataFrame, c: np.ndarray, nprobe: int) -> DataFrame:
    """queries (query_id, vector) with `probes` (array<int>), their nprobe nearest centroids."""
    shared = queries.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        for b in batches:
            if b.num_rows:
                m = nearest_parts(kn.matrix(b.column(1)), shared.value, nprobe)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))], ["query_id", "vector", "probes"])

    q = queries.select("query_id", "vector")
    return q.mapInArrow(run, f"query_id long, vector {q.schema['vector'].dataType.simpleString()}, probes array<int>")


def block_probe(base: DataFrame, c: np.ndarray, queries: DataFrame, k: int, nprobe: int, m: Metric) -> DataFrame:
    """(query_id, external_id, distance) with the k nearest in each query's partitions among them."""

    def start(r):
        return kn.Nearest(m, r["q_vector"], k)

    def add(near, r):
        near.add(r["vector"], r["ids"], np.flatnonzero((r["q_probes"] == r["part_id"]).any(1)))

    def finish(near, r):
        i, ids, d, *_ = near.result()
        yield from _batches(r["q_ids"][i], ids, d, names=["query_id", "external_id", "distance"])

    return meet(base, with_probes(queries, c, nprobe), start, add, finish, _SCORED, k, part="part_id", probes="probes")
