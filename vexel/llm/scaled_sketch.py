"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space. It
grows with its document, so the share of one sketch found in another estimates the containment of a
short document in a long one without bias, and the sketch of a union is the union of the sketches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import cut, drop_cut, map_arrow, quoted, table

SHINGLE = 5
#: The part of the hash space that is kept (at most 1/2, so that hashes are positive as long integers).
FRACTION = 1 / 2
MIN_CONTAINMENT = 0.5
#: Shingles of all benchmark items up to which they go to every task (16 bytes each); beyond that they are joined by hash.
INDEX_SHINGLES = 4_000_000


def sketch_arrays(texts: pa.Array, shingle: int = SHINGLE, fraction: float = FRACTION) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted kept hashes of each text, end to end."""
    buf, off = tv.column_bytes(texts)
    limit = tv.U64(int(fraction * (1 << 64)) - 1)
    values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in tv.chunks(off):
        h, _, first = tv.words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        s, row, _ = tv.shingles(h, first, shingle)
        low = s <= limit
        s, row = s[low], row[low]
        order = np.lexsort((s, row))
        s, row = s[order], row[order]
        if len(s):
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (row[1:] != row[:-1])])
            s, row = s[new], row[new]
        values.append(s.view(np.int64))
        counts.append(np.bincount(row, minlength=j - i))
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """(key, sketch) of every row. A null or wordless text has an empty sketch; one shorter than a shingle is one shingle; equal rows have equal sketches; a text of any length counts whole. Empty in, empty out; other columns are not looked at."""
    d = docs.select(F.col(quoted(key)), F.col(quoted(text)).cast("string"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            v, off = sketch_arrays(b.column(1), shingle, fraction)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(v))], schema.names)

    return map_arrow(d, run, schema)


def merged(sketched: DataFrame, by: str) -> DataFrame:
    """(by, sketch): the sketch of all texts of a group together, without looking at the texts again."""
    return sketched.select(by, F.explode("sketch").alias("h")).distinct().groupBy(by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def containment(small: DataFrame, large: DataFrame, small_key: str, large_key: str, least: float = MIN_CONTAINMENT) -> DataFrame:
    """(small_key, large_key, containment): the estimated part of the small text's shingles that the large one has, where it is at least `least`.

    One equi-join on the kept hashes; null keys and empty sketches match nothing.
    """
    a = small.where(F.col(small_key).isNotNull()).select(F.col(small_key).alias("a"), F.explode("sketch").alias("h")).distinct()
    b = large.where(F.col(large_key).isNotNull()).select(F.col(large_key).alias("b"), F.explode("sketch").alias("h")).distinct()
    size = a.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    hits = a.join(b, "h").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(size, "a").where(F.col("n") >= least * F.col("size"))
    return hits.select(F.col("a").alias(small_key), F.col("b").alias(large_key), (F.col("n") / F.col("size")).alias("containment"))


class Items:
    """All shingles of some items, as arrays: which items a text contains is then found by look-ups in one pass over it."""

    def __init__(self, ids: pa.Array, sketches: pa.ListArray):
        n = np.diff(sketches.offsets.to_numpy())
        h, item = sketches.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
        order = np.argsort(h, kind="stable")
        self.ids, self.size, self.item = ids, n, item[order]
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.first = np.append(self.first, len(h))

    def within(self, values: np.ndarray, offsets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, containment) where at least `least` of the item's shingles are among the text's values."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == values)
        row, at = np.searchsorted(offsets, hit, "right") - 1, at[hit]
        n = self.first[at + 1] - self.first[at]
        every = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair, count = np.unique(np.repeat(row, n) * len(self.size) + self.item[every], return_counts=True)
        row, item = pair // len(self.size), pair % len(self.size)
        share = count / self.size[item]
        ok = share >= least
        return row[ok], item[ok], share[ok]


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", fraction: float = FRACTION, least: float = MIN_CONTAINMENT, most: int = INDEX_SHINGLES) -> DataFrame:
    """(key, sketch, contains) of every row: its sketch and the items (item_key, containment) of whose shingles it has at least `least`, null if none.

    Containment is counted over all shingles of both sides, kept by the sketch or not. Rows of one item_id are one item, their shingles
    together; null item ids and wordless items are in nothing, null and empty texts contain nothing; repeated rows have a row each. Items that tie are all given, in the order of their ids.
    A text of any length is read whole. Items beyond `most` shingles are joined by hash, rows apart by a number. Empty in, empty out; other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    items = items.select(F.col(quoted(item_key)).alias("item"), F.col(quoted(text)).cast("string").alias("text"))
    whole = cut(merged(sketches(items, "item", "text", fraction=1.0).where("item IS NOT NULL"), "item"), "items")
    pair = T.StructType([T.StructField(item_key, items.schema["item"].dataType), T.StructField("containment", T.DoubleType())])
    schema = T.StructType([T.StructField(key, docs.schema["key"].dataType), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("contains", T.ArrayType(pair))])
    if (whole.select(F.sum(F.size("sketch"))).first()[0] or 0) > most:
        d = cut(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
        found = containment(whole, sketches(d, "row", "text", fraction=1.0), "item", "row", least)
        found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item", "containment"))).cast(T.ArrayType(pair)).alias("contains"))
        kept = sketches(d, "row", "text", fraction=fraction)
        return d.select("key", "row").join(kept, "row").join(found, "row", "left").select("key", "sketch", "contains").toDF(*schema.names)
    t = whole.orderBy("item").toArrow().combine_chunks()
    drop_cut(whole)
    index = spark.sparkContext.broadcast(Items(t["item"].combine_chunks(), t["sketch"].combine_chunks()))
    limit = int(fraction * (1 << 64)) - 1

    def run(batches):
        own = index.value
        for b in batches:
            v, off = sketch_arrays(b.column(1), fraction=1.0)
            row, item, share = own.within(v, off, least)
            pairs = pa.StructArray.from_arrays([own.ids.take(pa.array(item)), pa.array(share)], [item_key, "containment"])
            n = np.bincount(row, minlength=b.num_rows)
            contains = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pairs, mask=pa.array(n == 0))
            low = np.append(0, np.cumsum(v.view(np.uint64) <= np.uint64(limit)))
            sketch = pa.ListArray.from_arrays(pa.array(low[off].astype(np.int32)), pa.array(v[low[1:] > low[:-1]]))
            yield pa.RecordBatch.from_arrays([b.column(0), sketch, contains], schema.names)

    return map_arrow(docs, run, schema)


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_hashes, est_shingles, sketch, contains) of every document.

    contains: the benchmark items at least half of whose shingles the document has, as an array of (item_id, containment), counted over all shingles.
    """
    d = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("sketch")
    return d.select("doc_id", n.alias("n_hashes"), (n / F.lit(FRACTION)).alias("est_shingles"), "sketch", "contains")
