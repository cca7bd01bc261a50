"""Product quantisation: training, codes, and the distances that are taken from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as kn
from ..functions.distance import distance
from ..functions.metrics import Metric, as_metric
from .ivf import ivf_query, probe, probed_by, probing, with_probes
from .kmeans import centroid_matrix, sample
from .knn import _SCORED, BLOCK, BROADCAST_BYTES, _batches, collect_queries, is_small, meet, running_top_k
from .topk import top_k

CODEBOOK = "subspace int, code short, centroid array<float>"
CLUSTERS = 256


def check_subspaces(dims: int, subspaces: int) -> None:
    if subspaces < 1 or dims % subspaces:
        raise ValueError(f"{dims} dimensions can't be cut into {subspaces} equal subspaces")


def train_pq(df: DataFrame, subspaces: int, clusters: int = CLUSTERS, max_iter: int = 10, tol: float = 1e-4, seed: int = 0, sample_size: int = 100_000) -> DataFrame:
    """(subspace, code, centroid): k-means of each subspace over at most sample_size vectors, all subspaces side by side."""
    d = sample(df, sample_size, "RANDOM", seed).withColumn("_o", F.xxhash64("external_id", F.lit(seed)))
    width = F.size("vector") / subspaces
    parts = F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda s: F.struct(s.alias("subspace"), F.slice("vector", (s * width + 1).cast("int"), width.cast("int")).alias("sub")))
    d = d.select("_o", "external_id", F.explode(parts).alias("p")).select("_o", "external_id", "p.*")

    def run(t):
        t = t.sort_by([("_o", "ascending"), ("external_id", "ascending")])
        x = kn.matrix(t["sub"])
        c = np.zeros((clusters, x.shape[1]))
        start = np.unique(x, axis=0, return_index=True)[1]
        start = np.sort(start)[:clusters]
        c[: len(start)] = x[start]
        c = kn.lloyd(x, c, max_iter, tol) if len(x) > clusters else c
        s = t["subspace"][0].as_py()
        return pa.table({"subspace": pa.array([s] * clusters, pa.int32()), "code": pa.array(range(clusters), pa.int16()), "centroid": pa.array(list(c.astype(np.float32)), pa.list_(pa.float32()))})

    return d.groupBy("subspace").applyInArrow(run, CODEBOOK)


def codebook_array(book: DataFrame) -> np.ndarray:
    """subspaces x codes x width."""
    t = book.toArrow().sort_by([("subspace", "ascending"), ("code", "ascending")])
    m = len(set(t["subspace"].to_pylist()))
    x = kn.matrix(t["centroid"])
    return x.reshape(m, -1, x.shape[1])


def encode(df: DataFrame, book: DataFrame) -> DataFrame:
    """df with `codes` (array<short>): per subspace the nearest sub-centroid, the least of equally near ones."""
    shared = df.sparkSession.sparkContext.broadcast(codebook_array(book))
    at = df.columns.index("vector")

    def run(batches):
        cb = shared.value
        m, _, w = cb.shape
        for b in batches:
            x = kn.matrix(b.column(at))
            if b.num_rows and x.shape[1] != m * w:
                raise ValueError("vectors don't fit the codebook")
            codes = [np.stack([kn.nearest_row(x[:, s * w : (s + 1) * w], cb[s])[0] for s in range(m)], 1)] if b.num_rows else [np.zeros((0, m), int)]
            flat = pa.array(codes[0].ravel().astype(np.int16))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * m), flat)], [*b.schema.names, "codes"])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("array<short>").alias("codes")).schema)


def decode(encoded: DataFrame, book: DataFrame) -> DataFrame:
    """encoded with `decoded`: the sub-centroids of the codes, end to end."""
    cb = book.groupBy("subspace").agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "centroid"))), lambda s: s["centroid"]).alias("c"))
    cb = cb.agg(F.transform(F.sort_array(F.collect_list(F.struct("subspace", "c"))), lambda s: s["c"]).alias("_cb"))
    return encoded.crossJoin(F.broadcast(cb)).withColumn("decoded", F.flatten(F.transform("codes", lambda c, s: F.get(F.get(F.col("_cb"), s), c.cast("int"))))).drop("_cb")


def _decoded(codes: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """What rows of codes stand for."""
    return np.concatenate([cb[s][codes[:, s]] for s in range(cb.shape[0])], 1) if len(codes) else np.zeros((0, cb.shape[0] * cb.shape[2]))


def _coded(q: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """What the queries' own codes stand for."""
    m, _, w = cb.shape
    return _decoded(np.stack([kn.nearest_row(q[:, s * w : (s + 1) * w], cb[s])[0] for s in range(m)], 1), cb) if len(q) else q


_RANKED = f"{_SCORED}, exact double"


def _code_top_k(encoded: DataFrame, cb: np.ndarray, queries: DataFrame, k: int, metric: Metric, broadcast_bytes: int, c: np.ndarray | None = None, nprobe: int = 0, symmetric: bool = False, ranked: bool = False) -> DataFrame:
    """(query_id, external_id, distance) with the k nearest by codes to each query among them; ranked: and `exact`, the distance of their vectors, taken as they come in.

    Distances by codes are those to the decoded vectors, summed by subspace: pairs that can be among the nearest are found by a matrix product. c, nprobe: only the partitions
    of the nprobe nearest centroids. Queries beyond broadcast_bytes are taken in blocks that meet blocks of codes.
    """
    width, spark = cb.shape[2], encoded.sparkSession
    shared = spark.sparkContext.broadcast(cb)
    if ranked or not is_small(queries, broadcast_bytes, k):
        queries = queries.select("query_id", "vector")

        def start(r):
            return kn.Nearest(metric, _coded(r["q_vector"], shared.value) if symmetric else r["q_vector"], k)

        def add(near, r):
            more = (lambda i, j: kn.exact_pairs(metric, r["q_vector"], r["vector"], i, j)) if ranked else None
            near.add(_decoded(r["codes"], shared.value), r["ids"], None if c is None else np.flatnonzero((r["q_probes"] == r["part_id"]).any(1)), width, more)

        def finish(near, r):
            i, ids, d, *x = near.result()
            yield from _batches(r["q_ids"][i], ids, d, *([x[0] if x else d] if ranked else []), names=["query_id", "external_id", "distance", *(["exact"] if ranked else [])])

        part = {} if c is None else {"part": "part_id", "probes": "probes"}
        columns = ("vector", "codes") if ranked else ("codes",)
        return meet(encoded.select("external_id", *columns, *([] if c is None else ["part_id"])), queries if c is None else with_probes(queries, c, nprobe), start, add, finish, _RANKED if ranked else _SCORED, k, columns, **part)
    qid, q = collect_queries(queries)
    by = None if c is None else probed_by(q, c, nprobe)
    sent = spark.sparkContext.broadcast((qid, _coded(q, cb) if symmetric else q, by))

    def run(batches):
        qid, q, by = sent.value

        def score(b, held):
            x, ids = _decoded(kn.matrix(b.column(1)).astype(np.int64), shared.value), b.column(0).to_numpy()
            if by is None:
                for s in range(0, len(ids), BLOCK):
                    for near, _, _ in held:
                        near.add(x[s : s + BLOCK], ids[s : s + BLOCK], None, width)
            else:
                for _, at, near, rows in probing(b.column(2).to_numpy(), by, held):
                    near.add(x[at], ids[at], rows, width)

        return running_top_k(batches, metric, k, qid, q, score)

    if by is not None and len(by) < len(c):
        encoded = encoded.where(F.col("part_id").isin(sorted(by)))
    return encoded.select("external_id", "codes", *([] if by is None else ["part_id"])).mapInArrow(run, _SCORED)


def _ranked_anew(found: DataFrame, wide: int, k: int, m: Metric) -> DataFrame:
    """The k nearest by `exact` of the `wide` nearest by codes."""
    d = F.col("distance").desc() if m.descending else F.col("distance").asc()
    w = Window.partitionBy("query_id").orderBy(d, F.col("external_id").asc())
    first = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= wide)
    return top_k(first.select("query_id", "external_id", F.col("exact").alias("distance")), k, m)


def adc_query(encoded: DataFrame, book: DataFrame, queries: DataFrame, k: int, metric: Metric | int | str = Metric.SUM_OF_SQUARES, broadcast_bytes: int = BROADCAST_BYTES, wide: int | None = None) -> DataFrame:
    """The k nearest by distance of the raw query to the decoded vectors. wide: so many by codes, of which the k nearest by exact distance are given back (encoded has their vectors)."""
    cb, m = codebook_array(book), as_metric(metric)
    if wide:
        return _ranked_anew(_code_top_k(encoded, cb, queries, wide, m, broadcast_bytes, ranked=True), wide, k, m)
    return top_k(_code_top_k(encoded, cb, queries, k, m, broadcast_bytes), k, m)


def symmetric_query(encoded: DataFrame, book: DataFrame, queries: DataFrame, k: int, metric: Metric | int | str = Metric.SUM_OF_SQUARES, broadcast_bytes: int = BROADCAST_BYTES, wide: int | None = None) -> DataFrame:
    """adc_query() with the queries encoded too: distances between decoded vectors."""
    cb, m = codebook_array(book), as_metric(metric)
    if wide:
        return _ranked_anew(_code_top_k(encoded, cb, queries, wide, m, broadcast_bytes, symmetric=True, ranked=True), wide, k, m)
    return top_k(_code_top_k(encoded, cb, queries, k, m, broadcast_bytes, symmetric=True), k, m)


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: Metric | int | str = Metric.SUM_OF_SQUARES, few: bool = False) -> DataFrame:
    """The k nearest of the candidates by their exact distance: one join to the vectors by id. few: the candidates are known to be few enough to go to every task, so that no vector is shuffled."""
    q = queries.select("query_id", F.col("vector").alias("_q"))
    own = candidates.select("query_id", "external_id").distinct()
    near = base.select("external_id", "vector").join(F.broadcast(own) if few else own, "external_id")
    c = near.join(q, "query_id")
    return top_k(c.select("query_id", "external_id", distance(metric, "_q", "vector").alias("distance")), k, metric)


def ivf_pq_query(encoded: DataFrame, centroids: DataFrame, book: DataFrame, queries: DataFrame, k: int, nprobe: int = 100, k_factor: float = 1.0, metric: Metric | int | str = Metric.SUM_OF_SQUARES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Nearest by codes among the nprobe partitions; with k_factor > 1, floor(k * k_factor) of them are ranked anew by exact distance.

    encoded: (external_id, vector, part_id, codes). Queries beyond broadcast_bytes are taken in blocks. Where at least as many are ranked anew as there are vectors, codes leave
    nothing out, and the search is ivf_query().
    """
    if k_factor < 1:
        raise ValueError("k_factor must be at least 1")
    m, wide = as_metric(metric), int(k * k_factor)
    if wide > max(k, BLOCK) and encoded.select("external_id").limit(wide + 1).count() <= wide:
        return ivf_query(encoded, centroids, queries, k, nprobe, m, broadcast_bytes)
    cb, c = codebook_array(book), centroid_matrix(centroids)
    found = _code_top_k(encoded, cb, queries, wide, m, broadcast_bytes, c, nprobe, ranked=wide > k)
    return top_k(found, k, m) if wide == k else _ranked_anew(found, wide, k, m)


def pq_errors(encoded: DataFrame, book: DataFrame) -> DataFrame:
    """One row (mean_error, max_error, relative_error): sums of squares between vectors and what their codes stand for."""
    from ..functions.distance import squared_norm, sum_of_squares

    d = decode(encoded, book).select(sum_of_squares("vector", "decoded").alias("e"), squared_norm("vector").alias("n"))
    return d.agg(F.avg("e").alias("mean_error"), F.max("e").alias("max_error"), (F.sum("e") / F.sum("n")).alias("relative_error"))


__all__ = ["adc_query", "check_subspaces", "decode", "encode", "ivf_pq_query", "pq_errors", "probe", "rerank", "symmetric_query", "train_pq"]
