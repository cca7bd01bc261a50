"""Packing documents into sequences: best fit under conflicts.

Documents of a shard, longest first, go one by one into the open bin with the least room that
still takes them. Open bins are kept ordered by residual room; each carries a bitmap of the
sources that have their fill in it and one of the duplicate clusters it holds. The search starts at the
first bin with enough room and goes on to its successors until one is compatible, so the
bin taken is the tightest compatible one. After WALK successors the rest are compared at once, as arrays, and a source or cluster
that bars all open bins is known by its count, so no item costs a walk over all bins. Shards are of bounded size and packed side by side.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import cut, drop_cut, quoted, table
from .simhash_forest import near_duplicates

CAPACITY = 4096
MAX_PER_SOURCE = 4
SHARD_ROWS = 20_000
#: Successors looked at one by one.
WALK = 32


class _Bins:
    """Numbers of bins, in an array that grows."""

    def __init__(self):
        self.at, self.n = np.empty(4, np.int64), 0

    def add(self, b: int) -> None:
        if self.n == len(self.at):
            self.at = np.concatenate([self.at, np.empty_like(self.at)])
        self.at[self.n] = b
        self.n += 1


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE) -> list[int]:
    """The bin of each item (sizes from 1 to capacity), items being placed in the order given, longest first.

    Of equally tight bins the oldest is taken.
    """
    names = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    often = [c for c, n in Counter(clusters).items() if n > 1]
    number = {c: i for i, c in enumerate(often)}  # a cluster met once can't conflict
    least = [0] * (len(sizes) + 1)  # the least size still to come
    least[-1] = capacity + 1
    for i in range(len(sizes) - 1, -1, -1):
        least[i] = min(least[i + 1], sizes[i])
    order: list[tuple[int, int]] = []  # (room, bin) of the open bins, sorted
    room_of = np.full(max(1, len(sizes)), -1, np.int64)
    full: list[int] = []  # per bin: the bitmap of the sources that have their fill, and of its clusters
    held: list[int] = []
    count: list[dict[int, int]] = []
    inside: list[list[int]] = []
    barred: dict[tuple[str, int], _Bins] = {}  # bins closed to a source or cluster; how many of them are open
    shut: Counter = Counter()
    none, out = 1 << 62, []
    for i, size in enumerate(sizes):
        s, c = names[sources[i]], number.get(clusters[i], -1)
        s_bit, c_bit = 1 << s, 1 << c if c >= 0 else 0
        keys = (("s", s), ("c", c)) if c >= 0 else (("s", s),)
        b, n = -1, len(order)
        at = bisect_left(order, (size, -1))
        if at < n and all(shut[k] < n for k in keys):
            end = min(n, at + WALK)
            while at < end and (full[order[at][1]] & s_bit or held[order[at][1]] & c_bit):
                at += 1
            if at < end:
                b = order[at][1]
            elif at < n:
                room = room_of[: len(full)].copy()
                room[room < size] = none
                for k in keys:
                    if k in barred:
                        room[barred[k].at[: barred[k].n]] = none
                b = int(room.argmin())
                if room[b] == none:
                    b = -1
                else:
                    at = bisect_left(order, (int(room[b]), b))
        if b >= 0:
            room = order.pop(at)[0]
        else:
            room, b = capacity, len(full)
            full.append(0)
            held.append(0)
            count.append({})
            inside.append([])
        out.append(b)
        if c >= 0:
            held[b] |= c_bit
            inside[b].append(c)
            barred.setdefault(("c", c), _Bins()).add(b)
            shut["c", c] += 1
        k = count[b][s] = count[b].get(s, 0) + 1
        if k == max_per_source:
            full[b] |= s_bit
            barred.setdefault(("s", s), _Bins()).add(b)
            shut["s", s] += 1
        if room - size >= least[i + 1]:
            insort(order, (room - size, b))
            room_of[b] = room - size
        else:  # nothing to come fits: closed
            room_of[b] = -1
            shut.subtract(("c", x) for x in inside[b])
            shut.subtract(("s", x) for x, k in count[b].items() if k >= max_per_source)
    return out


def items_of(docs: DataFrame, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, text_hash, tokens, cluster) of every row, by one pass over the texts' bytes.

    cluster: a hash of the column of that name (null: of the id and text alone), or of the words in their order, ASCII case folded.
    """
    text = F.col("text").cast("string")
    own = F.lit(None).cast("long") if cluster is None else F.when(F.col(quoted(cluster)).isNotNull(), F.xxhash64(quoted(cluster))).otherwise(F.xxhash64("doc_id", text, F.lit("alone")))
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), own.alias("own"), text.alias("text"))

    def run(batches):
        for b in batches:
            buf, off = tv.column_bytes(b.column(4))
            n, c = [np.zeros(0, np.int64)], [np.zeros(0, tv.U64)]
            for i, j in tv.chunks(off):
                if cluster is not None:
                    n.append(tv.word_counts(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
                    continue
                h, row, first = tv.words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                acc = np.concatenate([np.zeros(1, tv.U64), np.cumsum(tv.mix(h ^ tv.mix((np.arange(len(h)) - first[row]).astype(tv.U64))))])
                n.append(np.diff(first))
                c.append(acc[first[1:]] - acc[first[:-1]])
            group = b.column(3) if cluster is not None else pa.array(np.concatenate(c).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.concatenate(n)), group], ["doc_id", "source", "text_hash", "tokens", "cluster"])

    return d.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("source", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("text_hash", "tokens", "cluster"))]))


def _sharded(items: DataFrame, shard_rows: int) -> DataFrame:
    """items with `shard`: by a hash of id and cluster, and of the row itself where these are repeated so often that a shard would grow by them."""
    shards = max(1, -(-items.count() // shard_rows))
    plain = F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards))
    many = items.groupBy("doc_id", "cluster").count().where(F.col("count") > shard_rows // 20).select(F.col("doc_id").alias("many_id"), F.col("cluster").alias("many"))
    many = cut(many, "many")
    if shards == 1 or many.isEmpty():
        drop_cut(many)
        return items.withColumn("shard", plain)
    d = items.join(many, F.col("doc_id").eqNullSafe(F.col("many_id")) & (F.col("cluster") == F.col("many")), "left")
    return d.withColumn("shard", F.when(F.col("many").isNull(), plain).otherwise(F.pmod(F.xxhash64("row"), F.lit(shards)))).drop("many_id", "many")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_rows: int = SHARD_ROWS, cluster: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """(bin_id, doc_id, source, piece, first_token, n_tokens): where each piece of each document goes.

    Tokens are words. A bin has at most `capacity` tokens, at most max_per_source pieces of one
    source, and no two documents of one duplicate cluster: the column `cluster`; or, with near (the result of near_duplicates(docs)), the groups of
    near duplicates, a document's being its kept id; or else the texts that
    have the same words in the same order, case and punctuation aside. A document longer than a bin is cut, however long it is: full pieces are bins of their own, the
    rest is packed. Each row is packed, so repeated rows go to different bins; a document without words (null or empty text) has one row with
    bin_id null. Null ids and sources are values like others; a null cluster is no cluster. Items are placed in the order of tokens (most first), id, source and cluster; what ties in all of these is alike.
    Rows that repeat an id and cluster by the thousand are spread over the shards one by one. Empty in, empty out; other columns are not looked at.
    """
    items = items_of(docs, cluster)
    if near is not None:
        own = near.select(F.col("doc_id").alias("near_id"), F.col("text_hash").alias("near_hash"), F.col("kept_id"))
        items = items.join(own, (F.col("doc_id") == F.col("near_id")) & (F.col("text_hash") == F.col("near_hash")), "left")
        items = items.select("doc_id", "source", "text_hash", "tokens", F.when(F.col("doc_id").isNull(), F.col("cluster")).otherwise(F.xxhash64(F.coalesce("kept_id", "doc_id"))).alias("cluster"))
    items = cut(items.drop("text_hash").withColumn("row", F.monotonically_increasing_id()), "items")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("doc_id", kind), *T._parse_datatype_string("source string, piece int, first_token long, n_tokens long").fields])

    def run(key, t):
        t = t.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        n = t["tokens"].to_numpy()
        whole, rest = n // capacity, n % capacity
        tail, none = np.flatnonzero(rest), np.flatnonzero(n == 0)
        row = np.concatenate([np.repeat(np.arange(len(n)), whole), tail])
        piece = np.concatenate([np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole), whole[tail]])
        size = np.concatenate([np.full(int(whole.sum()), capacity), rest[tail]])
        order = np.argsort(-size, kind="stable")
        row, piece, size = row[order], piece[order], size[order]
        source, group = t["source"].to_pylist(), t["cluster"].to_pylist()
        bins = np.array(pack(size.tolist(), [source[r] for r in row], [group[r] for r in row], capacity, max_per_source), np.int64)
        blank = np.zeros(len(none), np.int64)
        row = pa.array(np.concatenate([row, none]))
        return pa.table(
            {
                "bin_id": pa.array(np.concatenate([bins + (key[0].as_py() << 32), blank]), mask=np.arange(len(row)) >= len(bins)),
                "doc_id": t["doc_id"].take(row),
                "source": t["source"].take(row),
                "piece": pa.array(np.concatenate([piece, blank]).astype(np.int32)),
                "first_token": pa.array(np.concatenate([piece * capacity, blank])),
                "n_tokens": pa.array(np.concatenate([size, blank])),
            }
        )

    return _sharded(items, shard_rows).groupBy("shard").applyInArrow(run, schema)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of all documents, near duplicates apart: (bin_id, doc_id, source, piece, first_token, n_tokens)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack_documents(docs, near=near_duplicates(docs))
