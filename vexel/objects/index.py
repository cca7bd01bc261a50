"""ObjectIndex: an index together with the reader and the embedding its vectors come from."""

from __future__ import annotations

import importlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import store as st
from ..plans.index import create, open_index
from ..plans.ingest import ingest
from .embeddings import ObjectEmbedding
from .readers import ObjectReader

#: Candidates per result that are fetched where a filter is applied to what was found.
OVERFETCH = 50


def _describe(x) -> dict:
    return {"class": f"{type(x).__module__}.{type(x).__qualname__}", "kwargs": x.kwargs}


def _rebuild(d: dict, kind: type, allowed: tuple[str, ...]):
    """The object of a stored class path and arguments; only subclasses of `kind` from allowed packages, nothing stored is executed."""
    module, _, name = d["class"].rpartition(".")
    if not any(module == a or module.startswith(a + ".") for a in allowed):
        raise ValueError(f"{module} is not among the allowed packages {allowed}")
    cls = getattr(importlib.import_module(module), name)
    if not (isinstance(cls, type) and issubclass(cls, kind)):
        raise ValueError(f"{d['class']} is not a {kind.__name__}")
    return cls(**d["kwargs"])


def embed(df: DataFrame, embedding: ObjectEmbedding) -> DataFrame:
    """(external_id, vector) of objects with external_id; an object may have several vectors. The embedding is loaded once per task."""

    def run(batches):
        embedding.load()
        for b in batches:
            pdf = b.to_pandas()
            out = embedding.embed(pdf)
            x, ids = out if isinstance(out, tuple) else (out, pdf["external_id"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], ["external_id", "vector"])

    return df.mapInArrow(run, "external_id long, vector array<float>")


def _filtered(df: DataFrame, predicate) -> DataFrame:
    """(external_id) of the rows for which predicate(row as dict) holds: batch by batch, as it is Python code of the caller's."""
    at = df.columns.index("external_id")

    def run(batches):
        for b in batches:
            keep = pa.array([bool(predicate(r)) for r in b.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(at).filter(keep)], ["external_id"])

    return df.mapInArrow(run, "external_id long")


def merge_per_object(found: DataFrame, k: int, per_embedding=F.max, per_query=F.sum, by_rank: bool = True) -> DataFrame:
    """(query_id, rank, external_id, score) from (embedding_id, query_id, rank, external_id, distance): first the vectors of one object for each query vector, then each query's vectors, are merged by the given aggregates.

    A hit's score is 1 - (rank - 1) / hits, or with by_rank=False the reciprocal distance.
    """
    n = F.max("rank").over(_by("embedding_id"))
    score = 1 - (F.col("rank") - 1) / n if by_rank else 1 / F.when(F.col("distance") == 0, 1e-12).otherwise(F.col("distance"))
    s = found.withColumn("score", score).groupBy("embedding_id", "query_id", "external_id").agg(per_embedding("score").alias("score"))
    s = s.groupBy("query_id", "external_id").agg(per_query("score").alias("score"))
    w = _by("query_id").orderBy(F.col("score").desc(), "external_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "external_id", "score")


def _by(by: str):
    from pyspark.sql import Window

    return Window.partitionBy(by)


class ObjectIndex:
    def __init__(self, spark: SparkSession, uri: str, reader: ObjectReader, embedding: ObjectEmbedding, timestamp=None):
        self.spark, self.uri, self.reader, self.embedding = spark, uri, reader, embedding
        self.index = open_index(spark, uri, timestamp)

    @classmethod
    def create(cls, spark: SparkSession, uri: str, index_type: str, reader: ObjectReader, embedding: ObjectEmbedding, **params) -> ObjectIndex:
        create(spark, uri, index_type, embedding.dimensions, **params)
        s = st.Store(spark, uri)
        s.save(s.load() | {"object": {"reader": _describe(reader), "embedding": _describe(embedding)}})
        return cls(spark, uri, reader, embedding)

    @classmethod
    def open(cls, spark: SparkSession, uri: str, timestamp=None, allowed: tuple[str, ...] = ("vexel",)) -> ObjectIndex:
        d = st.Store(spark, uri).load()["object"]
        return cls(spark, uri, _rebuild(d["reader"], ObjectReader, allowed), _rebuild(d["embedding"], ObjectEmbedding, allowed), timestamp)

    def update_object_reader(self, reader: ObjectReader) -> None:
        s = st.Store(self.spark, self.uri)
        meta = s.load()
        meta["object"]["reader"] = _describe(reader)
        s.save(meta)
        self.reader = reader

    def update_index(self, index_timestamp: int | None = None, use_updates: bool = False, **options) -> None:
        """Embeds all objects: into a fresh version, or into the update log, which is then consolidated."""
        v = embed(self.reader.objects(self.spark), self.embedding)
        meta = self.reader.metadata(self.spark)
        if meta is not None:
            meta.write.mode("overwrite").parquet(f"{self.index.store.uri}/object_metadata")
        if use_updates and self.index.size:
            self.index.update_batch(v, index_timestamp)
            self.index.consolidate_updates(**options)
        else:
            ingest(self.spark, self.index.index_type, self.uri, input_vectors=v, dimensions=self.embedding.dimensions, index_timestamp=index_timestamp, distance_metric=self.index.metric, **(self.index.params | options))
        self.index.refresh()

    def metadata(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.index.store.uri}/object_metadata")

    def query(self, objects: DataFrame, k: int, where: str | Column | None = None, filter_fn=None, filter_mode: str = "pre", merge: bool | None = None, per_embedding=F.max, per_query=F.sum, by_rank: bool = True, return_metadata: bool = False, return_objects: bool = False, **options) -> DataFrame:
        """Nearest objects of each query object (external_id is its query_id).

        where: predicate on the metadata; filter_fn: a Python predicate on a metadata row. With
        filter_mode 'pre' only matching vectors are searched (exact); with 'post' 50 * k are
        fetched and filtered. merge: sum up several vectors per object and query (default:
        where the embedding made several of a query); results then have `score` for `distance`.
        """
        q = embed(objects, self.embedding)
        from ..operators.cut import cut
        from pyspark.sql import Window

        if merge is None:
            q = cut(q)
            merge = not q.groupBy("external_id").count().where("count > 1").isEmpty()
        w = Window.partitionBy("external_id").orderBy("vector")
        q = q.withColumn("embedding_id", F.xxhash64("external_id", F.row_number().over(w)) if merge else F.col("external_id"))
        q = cut(q)
        allowed = None
        if where is not None or filter_fn is not None:
            m = self.metadata()
            m = m if where is None else m.where(where)
            if filter_fn is not None:
                m = _filtered(m, filter_fn)
            allowed = m.select("external_id").distinct()
        fetch = k * OVERFETCH if allowed is not None and filter_mode == "post" else k
        v = q.select(F.col("embedding_id").alias("query_id"), "vector")
        found = self.index.query(v, fetch, ids=allowed if filter_mode == "pre" else None, **options)
        if allowed is not None and filter_mode == "post":
            found = found.join(allowed, "external_id", "left_semi")
            if not merge:
                from ..operators.topk import top_k

                found = top_k(found.drop("rank"), k, self.index.metric)
        if merge:
            own = q.select("embedding_id", F.col("external_id").alias("query_id"))
            found = found.withColumnRenamed("query_id", "embedding_id").join(own, "embedding_id")
            found = merge_per_object(found, k, per_embedding, per_query, by_rank)
        if return_metadata:
            found = found.join(self.metadata(), "external_id", "left")
        if return_objects:
            o = self.reader.by_ids(self.spark, found)
            found = found.join(o.select("external_id", *[c for c in o.columns if c not in found.columns]), "external_id")
        return found


__all__ = ["ObjectIndex", "embed", "merge_per_object"]
