"""Exact k nearest neighbours.

Two plans of the same result. `knn`: queries, if they are few (their size is looked at), go to every task as one
matrix, each task keeps a running top-k over its part of the base, and the shuffle carries k
rows per query and task. Beyond that size both sides are packed into blocks; a task has some blocks of queries, meets
every block of the base with each, and keeps a running top-k, so that k rows per query leave it. `knn_expr` gives what was found
to the column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as kn
from ..functions.distance import distance
from ..functions.metrics import Metric, as_metric
from .cut import cut
from .topk import top_k

#: Bytes of query vectors (as doubles) up to which they are sent to every task.
BROADCAST_BYTES = 32 << 20
BLOCK = 2048
#: Bytes of one block of vectors, entries of one block's running top-k, and bytes of base blocks that a task may hold, each about.
BLOCK_BYTES, HELD, BASE_BYTES = 1 << 20, 1 << 21, 192 << 20
_SCORED = "query_id long, external_id long, distance double"


def vectors(df: DataFrame, id_col: str, vector_col: str, id_name: str = "external_id") -> DataFrame:
    """(id_name, vector) as the operators take them; rows with a null id or vector are left out."""
    return df.select(F.col(id_col).cast("long").alias(id_name), F.col(vector_col).alias("vector")).where(f"{id_name} is not null and vector is not null")


def knn_expr(base: DataFrame, queries: DataFrame, k: int, metric: Metric | int | str = Metric.SUM_OF_SQUARES) -> DataFrame:
    """knn() with distances by column expressions: of what a task's running top-k holds at the end, with its vectors, instead of all pairs."""
    m, double = as_metric(metric), "array<double>" in (base.schema["vector"].dataType.simpleString(), queries.schema["vector"].dataType.simpleString())
    base, queries = _whole(base, "external_id"), _whole(queries, "query_id")

    def start(r):
        return kn.Nearest(m, r["q_vector"], k)

    def add(near, r):
        near.add(r["vector"], r["ids"], more=lambda i, j: r["vector"][j])

    def finish(near, r):
        i, ids, _, *x = near.result()
        yield from _batches(r["q_ids"][i], ids, r["q_vector"][i], x[0] if x else r["q_vector"][i], names=["query_id", "external_id", "_q", "vector"], kind=np.float64 if double else np.float32)

    found = meet(base, queries, start, add, finish, f"query_id long, external_id long, _q array<{'double' if double else 'float'}>, vector array<{'double' if double else 'float'}>", k)
    return top_k(found.select("query_id", "external_id", distance(m, "_q", "vector").alias("distance")), k, m)


def _batches(*columns: np.ndarray, names: list[str], kind: type = np.float64) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded number of rows; columns of two dimensions become lists of `kind`."""

    def array(c):
        if c.ndim == 1:
            return pa.array(c)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel().astype(kind)))

    step = 2048 if any(c.ndim > 1 for c in columns) else 1 << 16
    for s in range(0, max(1, len(columns[0])), step):
        yield pa.RecordBatch.from_arrays([array(c[s : s + step]) for c in columns], names)


def running_top_k(batches, metric: Metric, k: int, qid: np.ndarray, q: np.ndarray, score) -> Iterator[pa.RecordBatch]:
    """The k nearest per query over all batches: score(batch, near, first, last) adds a batch to the running top-k of queries first to last - 1."""
    parts = [(s, min(s + BLOCK, len(q))) for s in range(0, len(q), BLOCK)]
    held = [kn.Nearest(metric, q[s:e], k) for s, e in parts]
    for b in batches:
        if b.num_rows:
            score(b, [(h, s, e) for h, (s, e) in zip(held, parts)])
    for h, (s, _) in zip(held, parts):
        i, ids, d, *_ = h.result()
        yield from _batches(qid[s + i], ids, d, names=["query_id", "external_id", "distance"])


def collect_queries(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = queries.select("query_id", "vector").toArrow().sort_by("query_id")
    return t["query_id"].to_numpy(), kn.matrix(t["vector"])


def is_small(queries: DataFrame, limit: int = BROADCAST_BYTES, k: int = 0) -> bool:
    """Whether the query vectors, and k results of each, have at most `limit` bytes: counted, unless the planner's estimate leaves no doubt."""
    if k <= 64 and int(str(queries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit // 16:
        return True
    n, d = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return n * max((d or 0) * 8, k * 24) <= limit


def knn(base: DataFrame, queries: DataFrame, k: int, metric: Metric | int | str = Metric.SUM_OF_SQUARES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, external_id, distance): the k nearest of base (external_id, vector) to each of queries (query_id, vector).

    Fewer than k rows where the base has fewer. Vectors of unequal length raise an error.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    m = as_metric(metric)
    base, queries = base.select("external_id", "vector"), queries.select("query_id", "vector")
    if not is_small(queries, broadcast_bytes, k):
        return top_k(block_top_k(base, queries, k, m), k, m)
    shared = base.sparkSession.sparkContext.broadcast(collect_queries(queries))

    def score(b, held):
        x, ids = kn.matrix(b.column(1)), b.column(0).to_numpy()
        for s in range(0, len(ids), BLOCK):
            for near, _, _ in held:
                near.add(x[s : s + BLOCK], ids[s : s + BLOCK])

    return top_k(base.mapInArrow(lambda batches: running_top_k(batches, m, k, *shared.value, score), _SCORED), k, m)


def _whole(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col, "vector").where(f"{id_col} is not null and vector is not null")


def _kind(df: DataFrame, c: str) -> str:
    return {"float": "<f4", "smallint": "<i2"}.get(df.schema[c].dataType.elementType.simpleString(), "<f8")


def pack(df: DataFrame, id_col: str, columns: tuple[str, ...] = ("vector",), part: str | None = None, probes: str | None = None, most: int = BLOCK) -> DataFrame:
    """Rows of up to `most` vectors, and BLOCK_BYTES, each: (ids, n, and each of `columns` as binary). part: a column that is the same in all of a block. probes: a column of int arrays, kept as binary, and as the array of those in the block."""
    kinds = {c: _kind(df, c) for c in columns}
    names = [id_col, *columns, *([part] if part else []), *([probes] if probes else [])]

    def block(p, rows):
        ids, x, pr = (np.concatenate([r[0] for r in rows]), [np.concatenate([r[1][c] for r in rows]) for c in range(len(columns))], [r[2] for r in rows])
        cols, out = [pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([len(ids)], pa.int32())], ["ids", "n"]
        for c, v in zip(columns, x):
            cols.append(pa.array([np.ascontiguousarray(v, kinds[c]).tobytes()], pa.binary()))
            out.append(c)
        if part:
            cols.append(pa.array([p], pa.int32()))
            out.append(part)
        if probes:
            m = np.concatenate(pr)
            cols += [pa.array([m.astype("<i4").tobytes()], pa.binary()), pa.array([np.unique(m).tolist()], pa.list_(pa.int32()))]
            out += [probes, "parts"]
        return pa.RecordBatch.from_arrays(cols, out)

    def run(batches):
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), [kn.matrix(b.column(1 + c)) for c in range(len(columns))]
            pr = kn.matrix(b.column(len(names) - 1)) if probes else None
            limit = max(1, min(most, BLOCK_BYTES // max(1, sum(v.shape[1] * int(kinds[c][-1]) for c, v in zip(columns, x)))))
            own = b.column(1 + len(columns)).to_numpy() if part else np.zeros(len(ids), np.int64)
            for p in np.unique(own).tolist():
                at = np.flatnonzero(own == p)
                while len(at):
                    rows, n = held.get(p, ([], 0))
                    now, at = at[: limit - n], at[limit - n :]
                    rows = [*rows, (ids[now], [v[now] for v in x], pr[now] if probes else None)]
                    held[p] = (rows, n + len(now))
                    if n + len(now) >= limit:
                        yield block(p, held.pop(p)[0])
            if sum(n for _, n in held.values()) > 32 * most:
                for p in list(held):
                    yield block(p, held.pop(p)[0])
        for p in held:
            yield block(p, held[p][0])

    fields = ["ids binary", "n int", *(f"{c} binary" for c in columns), *([f"{part} int"] if part else []), *([f"{probes} binary", "parts array<int>"] if probes else [])]
    return df.select(*names).mapInArrow(run, ", ".join(fields))


def meet(base: DataFrame, queries: DataFrame, start, add, finish, schema: str, k: int = 1, columns: tuple[str, ...] = ("vector",), part: str | None = None, probes: str | None = None) -> DataFrame:
    """Every block of queries meets every block of the base, or those in parts it probes, in one task or one for each BASE_BYTES of the base.

    start(row) makes a query block's state, add(state, row) sees one base block (giving batches or None), finish(state, row) gives batches. A row has ids, n, part and arrays of the
    columns; those of the query block begin with q_. The base is packed once into a table; a task's memory has the base blocks it reads, or BASE_BYTES of them, and one query block's state.
    """
    spark = base.sparkSession
    if part:
        base = base.repartition(part)  # whole blocks of one part
    b = cut(pack(base, "external_id", columns, part))
    n, blocks = b.agg(F.sum("n"), F.count(F.lit(1))).first()
    size = b.agg(F.sum(sum((F.length(c) for c in columns), F.lit(0)))).first()[0] or 0
    rows = queries.count()
    most = max(1, min(BLOCK, HELD // max(1, min(k, n or 1))))
    kinds = {c: _kind(base, c) for c in columns} | {"q_vector": _kind(queries, "vector")}
    tasks = max(1, min(-(-rows // most), 4 * spark.sparkContext.defaultParallelism))
    if probes:
        first = F.get(F.col(probes), F.lit(0))
        queries = queries.repartitionByRange(tasks, first, F.xxhash64("query_id")).sortWithinPartitions(first, "query_id")
    q = pack(queries, "query_id", ("vector",), probes=probes, most=most)
    q = q.select(F.monotonically_increasing_id().alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in q.columns])
    q = q if probes else q.repartition(tasks)
    pairs = q.join(b.coalesce(max(1, -(-size // BASE_BYTES))).hint("shuffle_replicate_nl"), F.array_contains("q_parts", F.col(part)) if probes else F.lit(True))
    pairs = pairs.drop("q_parts") if probes else pairs
    names = pairs.columns

    def whole(r: dict) -> dict:
        out = {}
        for c, v in r.items():
            if c in ("ids", "q_ids"):
                out[c] = np.frombuffer(v.as_buffer(), "<i8")
            elif c in kinds:
                n = r["q_n" if c.startswith("q_") else "n"].as_py()
                out[c] = np.frombuffer(v.as_buffer(), kinds[c]).reshape(n, -1).astype(np.float64 if kinds[c] != "<i2" else np.int64)
            elif probes and c == f"q_{probes}":
                out[c] = np.frombuffer(v.as_buffer(), "<i4").reshape(r["q_n"].as_py(), -1)
            else:
                out[c] = v.as_py()
        return out

    left, right = [c for c in names if c.startswith("q_")], [c for c in names if not c.startswith("q_")]

    def run(batches):
        state = own = None
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(names)}
            for i in range(batch.num_rows):
                block = at["q_block"][i].as_py()
                if own is None or own["q_block"] != block:
                    if own is not None:
                        yield from finish(state, own)
                    own = whole({c: at[c][i] for c in left})
                    state = start(own)
                yield from add(state, own | whole({c: at[c][i] for c in right})) or ()
        if own is not None:
            yield from finish(state, own)

    return pairs.mapInArrow(run, schema)


def block_top_k(base: DataFrame, queries: DataFrame, k: int, m: Metric) -> DataFrame:
    """(query_id, external_id, distance) with the k nearest of each query among them."""

    def start(r):
        return kn.Nearest(m, r["q_vector"], k)

    def add(near, r):
        near.add(r["vector"], r["ids"])

    def finish(near, r):
        i, ids, d, *_ = near.result()
        yield from _batches(r["q_ids"][i], ids, d, names=["query_id", "external_id", "distance"])

    return meet(base, queries, start, add, finish, _SCORED, k)


def radius_search(base: DataFrame, queries: DataFrame, radius: float, metric: Metric | int | str = Metric.L2) -> DataFrame:
    """(query_id, external_id, distance) of all pairs not farther than the radius (for inner product: not below it)."""
    m = as_metric(metric)

    def start(r):
        scan = kn.Scan(m, r["q_vector"])
        return scan, scan.keys_of(np.full(len(scan.q), float(radius)), slice(None)) + 0 * scan.norm

    def add(state, r):
        scan, bound = state
        i, j = scan.pairs(r["vector"], bound)
        d = scan.distances(i, j, r["vector"])
        at = np.flatnonzero(~(d < radius) if m.descending else d <= radius)
        yield from _batches(r["q_ids"][i[at]], r["ids"][j[at]], d[at], names=["query_id", "external_id", "distance"])

    return meet(_whole(base, "external_id"), _whole(queries, "query_id"), start, add, lambda state, r: (), _SCORED)
