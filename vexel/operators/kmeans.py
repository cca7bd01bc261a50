"""k-means: seeds, Lloyd's iterations on the driver's sample or over the whole table, assignment, medoid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as kn
from .cut import cut

#: Bytes of vectors (as doubles) that a fit may bring to the driver.
DRIVER_BYTES = 512 << 20
CENTROIDS = "part_id int, centroid array<float>"


def centroid_table(spark: SparkSession, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(c)], CENTROIDS)


def centroid_matrix(centroids: DataFrame) -> np.ndarray:
    t = centroids.select("part_id", "centroid").toArrow().sort_by("part_id")
    return kn.matrix(t["centroid"])


def sample(df: DataFrame, n: int, policy: str = "RANDOM", seed: int = 0) -> DataFrame:
    """n rows: those with the least ids (FIRST_N) or with the least seeded hashes (RANDOM)."""
    if policy == "FIRST_N":
        return df.orderBy("external_id").limit(n)
    h, rows = F.xxhash64("external_id", F.lit(seed)), df.count()
    wanted = n + 6 * int(n**0.5) + 10
    if rows > 2 * wanted:  # rows that can't be among the n least hashes are dropped before the sort
        df = df.where(h < F.lit(-(1 << 63) + ((1 << 64) * wanted) // rows))
    return df.orderBy(h, "external_id").limit(n)


def _collect(df: DataFrame, policy: str, n: int, seed: int) -> np.ndarray:
    """Up to n vectors in the policy's order."""
    d = sample(df, n, policy, seed).withColumn("_o", F.xxhash64("external_id", F.lit(seed)) if policy == "RANDOM" else F.col("external_id"))
    return kn.matrix(d.toArrow().sort_by([("_o", "ascending"), ("external_id", "ascending")])["vector"])


def init_centroids(df: DataFrame, k: int, init: str = "random", seed: int = 0, sample_rows: int = 20_000) -> np.ndarray:
    """k start centroids: 'first' (least ids), 'random' (distinct rows by seeded hash) or 'k-means++' (over at most sample_rows rows). With fewer rows than k the surplus is zero."""
    if init == "k-means++":
        return kn.kmeans_start(_collect(df, "RANDOM", max(k, sample_rows), seed), k, seed)
    if init not in ("random", "first"):
        raise ValueError(f"unknown init {init!r}")
    x = _collect(df, "RANDOM" if init == "random" else "FIRST_N", k, seed)
    c = np.zeros((k, x.shape[1]))
    c[: len(x)] = x
    return c


def lloyd_step(df: DataFrame, c: np.ndarray) -> np.ndarray:
    """One Lloyd round over the whole table: the new centroids."""
    return lloyd_sums(df, c)[0]


def lloyd_sums(df: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, vectors of each) of a round over the whole table: per task sums and counts, added up per centroid. An empty centroid stays."""
    shared = df.sparkSession.sparkContext.broadcast(c)

    def partial(batches):
        c = shared.value
        sums, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                x = kn.matrix(b.column(0))
                part, _ = kn.nearest_row(x, c)
                np.add.at(sums, part, x)
                n += np.bincount(part, minlength=len(c))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(sums[at]), pa.list_(pa.float64())), pa.array(n[at])], ["part_id", "total", "n"])

    def add(t):
        return pa.table({"part_id": t["part_id"].slice(0, 1), "total": pa.array([kn.matrix(t["total"]).sum(0)], pa.list_(pa.float64())), "n": pa.array([int(t["n"].to_numpy().sum())])})

    schema = "part_id int, total array<double>, n long"
    t = df.select("vector").mapInArrow(partial, schema).groupBy("part_id").applyInArrow(add, schema).toArrow()
    out, n = c.copy(), np.zeros(len(c), np.int64)
    if len(t):
        n[t["part_id"].to_numpy()] = t["n"].to_numpy()
        out[t["part_id"].to_numpy()] = kn.matrix(t["total"]) / t["n"].to_numpy()[:, None]
    return out, n


def kmeans_fit(df: DataFrame, k: int, init: str = "random", max_iter: int = 10, tol: float = 1e-4, seed: int = 0, sample_size: int | None = None, reassign: float = 0.0, policy: str = "RANDOM", driver_bytes: int = DRIVER_BYTES) -> DataFrame:
    """(part_id, centroid). With sample_size the fit is over that many rows, on the driver if they have at most driver_bytes; else every round reads the whole sample or table, task by task.

    Stops after max_iter rounds or when no centroid moved by more than tol times the centroids' total square. reassign: after each round but the last, centroids with fewer than this part of the
    mean number of vectors go to vectors drawn by hash.
    """
    if sample_size is not None:
        dims = df.select(F.max(F.size("vector"))).first()[0] or 0
        if sample_size * dims * 8 <= driver_bytes or df.count() * dims * 8 <= driver_bytes:
            x = _collect(df, policy, sample_size, seed)
            if init == "k-means++":
                c = kn.kmeans_start(x, k, seed)
            else:
                c = np.zeros((k, x.shape[1]))
                c[: min(k, len(x))] = x[:k]
            return centroid_table(df.sparkSession, kn.lloyd(x, c, max_iter, tol, reassign) if len(x) > k else c)
        df = cut(sample(df, sample_size, policy, seed).select("external_id", "vector"))
    c = init_centroids(df, k, init, seed)
    for i in range(max_iter):
        new, n = lloyd_sums(df, c)
        if reassign and i < max_iter - 1:
            low = np.flatnonzero(n < reassign * n.sum() / max(1, k))
            if len(low):
                fresh = _collect(df, "RANDOM", len(low), seed + i + 1)
                new[low[: len(fresh)]] = fresh
        shift = float(np.einsum("ij,ij->i", new - c, new - c).max()) if len(c) else 0.0
        c = new
        if shift < tol * float(np.einsum("ij,ij->", c, c)):
            break
    return centroid_table(df.sparkSession, c)


def assign(df: DataFrame, centroids: DataFrame, with_distance: bool = False) -> DataFrame:
    """df with part_id, the nearest centroid (the least of equally near ones), and its sum of squares as `score` if asked for."""
    shared = df.sparkSession.sparkContext.broadcast(centroid_matrix(centroids))
    at = df.columns.index("vector")

    def run(batches):
        for b in batches:
            part, d = kn.nearest_row(kn.matrix(b.column(at)), shared.value) if b.num_rows else (np.zeros(0, int), np.zeros(0))
            more = [pa.array(part.astype(np.int32)), *([pa.array(d)] if with_distance else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "part_id", *(["score"] if with_distance else [])])

    schema = df.select("*", F.lit(0).alias("part_id"), *([F.lit(0.0).alias("score")] if with_distance else [])).schema
    return df.mapInArrow(run, schema)


kmeans_predict = assign


def mean_vector(df: DataFrame) -> DataFrame:
    """(pos, mean): the mean of each element over all vectors."""
    return df.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def medoid(df: DataFrame) -> DataFrame:
    """One row (external_id, distance): the vector nearest to the mean, by sum of squares; the least id of equally near ones."""
    from ..functions.distance import sum_of_squares

    mean = mean_vector(df).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("_m"))
    d = df.crossJoin(F.broadcast(mean)).select("external_id", sum_of_squares("vector", "_m").alias("distance"))
    return d.select(F.min_by(F.struct("external_id", "distance"), F.struct("distance", "external_id")).alias("s")).select("s.*").where("external_id is not null")


def partition_sizes(assigned: DataFrame) -> DataFrame:
    """(part_id, size)."""
    return assigned.groupBy("part_id").agg(F.count(F.lit(1)).alias("size"))


def partition_offsets(assigned: DataFrame) -> DataFrame:
    """(part_id, size, start): where each partition would start if they were laid end to end. One row per partition goes through one task."""
    from pyspark.sql import Window

    w = Window.orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
    return partition_sizes(assigned).withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))
