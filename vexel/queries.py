"""The registered queries over the `embeddings`, `documents` and `labels` tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import Metric, cosine_normalized, normalize, quantize_int8, squared_norm, subify, sum_of_squares
from .objects.embeddings import ColumnEmbedding
from .objects.index import ObjectIndex, merge_per_object
from .objects.readers import TableReader
from .operators import graph, ivf, kmeans, knn, pq, topk
from .operators.cut import cut
from .plans import ingest
from .plans import store as st
from .sources import coo_to_vectors
from .sources.vectors import read_ids, read_vectors, write_vectors

K = 10
PARTS = 16
NPROBE = 12
CODES = 256
SUBSPACES = 32
WIDTH = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str = "embeddings") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small file would be one task: spread it over the cores."""
    return knn.vectors(_read(spark, sf_dir), "vec_id", "embedding").repartition(spark.sparkContext.defaultParallelism)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.vectors(_read(spark, sf_dir), "vec_id", "embedding", "query_id")


# SQL building blocks


def _ssq(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _n2(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))"


def _cos(a: str, b: str) -> str:
    m = f"sqrt({_n2(a)} * {_n2(b)})"
    return f"1 - {_ip(a, b)} / CASE WHEN {m} = 0 THEN 1 ELSE {m} END"


_DIST = {Metric.SUM_OF_SQUARES: _ssq, Metric.L2: lambda a, b: f"sqrt({_ssq(a, b)})", Metric.INNER_PRODUCT: _ip, Metric.COSINE: _cos}


def _top(scored: str, k: int = K, desc: bool = False, by: str = "distance") -> str:
    return f"SELECT query_id, CAST(rank AS INT) AS rank, external_id, {by} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by} {'DESC' if desc else 'ASC'}, external_id) AS rank FROM ({scored})) WHERE rank <= {k}"


def _all(metric: Metric = Metric.SUM_OF_SQUARES, where: str = "true", base: str = "SELECT vec_id AS external_id, embedding AS vector, label FROM embeddings") -> str:
    return f"SELECT q.vec_id AS query_id, e.external_id, {_DIST[metric]('q.embedding', 'e.vector')} AS distance FROM embeddings q CROSS JOIN ({base}) e WHERE {where}"


def _knn(metric: Metric):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return knn.knn(_base(spark, sf_dir), _queries(spark, sf_dir), K, metric)

    run.__doc__ = f"The {K} nearest of every vector to every vector, by {metric.name}."
    return run


for _name, _metric in (("knn_ssq", Metric.SUM_OF_SQUARES), ("knn_l2", Metric.L2), ("knn_ip", Metric.INNER_PRODUCT), ("knn_cosine", Metric.COSINE)):
    query(_top(_all(_metric), desc=_metric.descending), _name)(_knn(_metric))


@query(_top(_all()))
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_ssq by pairs of blocks, as for a large query side."""
    return knn.knn(_base(spark, sf_dir), _queries(spark, sf_dir), K, broadcast_bytes=0)


@query(_top(_all()))
def knn_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_ssq as a join with column expressions."""
    return knn.knn_expr(_base(spark, sf_dir), _queries(spark, sf_dir), K)


@query(f"SELECT vec_id, CAST(pos AS INT) AS pos, v / CASE WHEN n = 0 THEN 1 ELSE n END AS x FROM (SELECT vec_id, sqrt({_n2('embedding')}) AS n, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("vec_id", F.posexplode(normalize("embedding")).alias("pos", "x"))


@query(f"SELECT vec_id, {_n2('embedding')} AS squared, sqrt({_n2('embedding')}) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("vec_id", squared_norm("embedding").alias("squared"), F.sqrt(squared_norm("embedding")).alias("norm"))


@query(f"SELECT a.vec_id, {_ssq('a.embedding[9:24]', 'b.embedding[9:24]')} AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def subspace_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of squares over elements 8 to 23 between each vector and the next."""
    e = _read(spark, sf_dir).select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", sum_of_squares("embedding", "next", 8, 24).alias("distance"))


@query(f"SELECT vec_id, CAST(s AS INT) AS part, CAST(p - 1 AS INT) AS pos, x FROM (SELECT vec_id, s, unnest(embedding[s * 16 + 1 : s * 16 + 16]) AS x, generate_subscripts(embedding[s * 16 + 1 : s * 16 + 16], 1) AS p FROM embeddings CROSS JOIN range(4) r(s))")
def subify_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector cut into four parts."""
    parts = _read(spark, sf_dir).select("vec_id", F.posexplode(subify("embedding", 4)).alias("part", "v"))
    return parts.select("vec_id", "part", F.posexplode("v").alias("pos", "x"))


@query(f"SELECT a.vec_id, 1 - {_ip(f'list_transform(a.embedding, lambda x: x::DOUBLE / sqrt({_n2('a.embedding')}))', f'list_transform(b.embedding, lambda x: x::DOUBLE / sqrt({_n2('b.embedding')}))')} AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_of_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir).select("vec_id", normalize("embedding").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("next"))
    return e.join(n, "vec_id").select("vec_id", cosine_normalized("v", "next").alias("distance"))


@query("""WITH r AS (SELECT pos, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)
SELECT vec_id, CAST(e.pos - 1 AS INT) AS pos, CAST(CASE WHEN hi = lo THEN 0 ELSE round((v - lo) / (hi - lo) * 255) END - 128 AS INT) AS x
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) e JOIN r ON e.pos = r.pos""")
def quantize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element mapped from its dimension's range to eight bits."""
    e = _read(spark, sf_dir)
    r = e.select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    r = r.agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("r")).select(F.transform("r", lambda s: s["lo"]).alias("lo"), F.transform("r", lambda s: s["hi"]).alias("hi"))
    q = e.crossJoin(F.broadcast(r)).select("vec_id", quantize_int8("embedding", F.col("lo"), F.col("hi")).alias("q"))
    return q.select("vec_id", F.posexplode("q").alias("pos", "x")).select("vec_id", "pos", F.col("x").cast("int").alias("x"))


@query(_top(_all(where="e.label = 3")))
def knn_label_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only vectors of label 3 are searched."""
    own = knn.vectors(_read(spark, sf_dir).where("label = 3"), "vec_id", "embedding")
    return knn.knn(own, _queries(spark, sf_dir), K)


@query(_top(f"SELECT query_id, external_id, distance FROM ({_top(_all(), 50 * K)}) t JOIN embeddings e ON e.vec_id = t.external_id WHERE e.label = 3"))
def knn_label_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 * k are fetched, then those of label 3 kept."""
    found = knn.knn(_base(spark, sf_dir), _queries(spark, sf_dir), 50 * K)
    label = _read(spark, sf_dir).where("label = 3").select(F.col("vec_id").alias("external_id"))
    return topk.top_k(found.drop("rank").join(label, "external_id", "left_semi"), K)


@query(_top(_all(where="q.vec_id <> e.external_id")))
def knn_exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.knn(_base(spark, sf_dir), _queries(spark, sf_dir), K + 1)
    return topk.top_k(found.drop("rank").where("query_id <> external_id"), K)


@query(f"SELECT query_id, external_id, distance FROM ({_all(Metric.L2)}) WHERE distance <= 1.1")
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.radius_search(_base(spark, sf_dir), _queries(spark, sf_dir), 1.1)


# Training and inverted files; centroids: the first PARTS vectors

_CENT = f"SELECT CAST(vec_id AS INT) AS part_id, embedding AS centroid FROM embeddings WHERE vec_id < {PARTS}"
_ASSIGN = f"SELECT vec_id AS external_id, embedding AS vector, part_id, score FROM (SELECT e.vec_id, e.embedding, c.part_id, {_ssq('e.embedding', 'c.centroid')} AS score, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_ssq('e.embedding', 'c.centroid')}, c.part_id) AS r FROM embeddings e CROSS JOIN ({_CENT}) c) WHERE r = 1"


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.centroid_table(spark, kmeans.init_centroids(_base(spark, sf_dir), PARTS, "first"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(_base(spark, sf_dir), _centroids(spark, sf_dir))


@query(f"SELECT external_id, part_id, score FROM ({_ASSIGN})")
def assign_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(_base(spark, sf_dir), _centroids(spark, sf_dir), True).select("external_id", "part_id", "score")


@query(f"SELECT part_id, count(*) AS size FROM ({_ASSIGN}) GROUP BY part_id")
def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.partition_sizes(_assigned(spark, sf_dir))


@query(f"SELECT part_id, size, CAST(sum(size) OVER (ORDER BY part_id) - size AS BIGINT) AS start FROM (SELECT part_id, count(*) AS size FROM ({_ASSIGN}) GROUP BY part_id)")
def partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.partition_offsets(_assigned(spark, sf_dir))


def _probe_sql(nprobe: int) -> str:
    return f"SELECT query_id, part_id FROM (SELECT q.vec_id AS query_id, c.part_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_ssq('q.embedding', 'c.centroid')}, c.part_id) AS r FROM embeddings q CROSS JOIN ({_CENT}) c) WHERE r <= {nprobe}"


def _ivf_sql(nprobe: int) -> str:
    return _top(f"SELECT p.query_id, a.external_id, {_ssq('q.embedding', 'a.vector')} AS distance FROM ({_probe_sql(nprobe)}) p JOIN ({_ASSIGN}) a ON a.part_id = p.part_id JOIN embeddings q ON q.vec_id = p.query_id")


@query(f"SELECT part_id, count(*) AS queries FROM ({_probe_sql(4)}) GROUP BY part_id")
def active_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.active_partitions(ivf.probe(_queries(spark, sf_dir), _centroids(spark, sf_dir), 4))


@query(_ivf_sql(NPROBE))
def ivf_query_nprobe12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.ivf_query(_assigned(spark, sf_dir), _centroids(spark, sf_dir), _queries(spark, sf_dir), K, NPROBE)


@query(_ivf_sql(NPROBE))
def ivf_query_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ivf_query_nprobe12 by the equi-join on part_id, as for many queries."""
    return ivf.ivf_query(_assigned(spark, sf_dir), _centroids(spark, sf_dir), _queries(spark, sf_dir), K, NPROBE, broadcast_bytes=0)


@query(_top(_all()))
def ivf_query_all_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.ivf_query(_assigned(spark, sf_dir), _centroids(spark, sf_dir), _queries(spark, sf_dir), K, PARTS)


def _round_sql(cent: str) -> str:
    near = f"SELECT vec_id, embedding, part_id FROM (SELECT e.vec_id, e.embedding, c.part_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_ssq('e.embedding', 'c.centroid')}, c.part_id) AS r FROM embeddings e CROSS JOIN {cent} c) WHERE r = 1"
    return f"SELECT part_id, list(m ORDER BY pos) AS centroid FROM (SELECT part_id, pos, avg(v) AS m FROM (SELECT part_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM ({near})) GROUP BY part_id, pos) GROUP BY part_id"


@query(f"WITH c0 AS ({_CENT}), c1 AS ({_round_sql('c0')}), c2 AS ({_round_sql('c1')}) SELECT part_id, CAST(pos - 1 AS INT) AS pos, round(x, 5) AS x FROM (SELECT part_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS pos FROM c2)")
def kmeans_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Lloyd rounds over the whole table from its first vectors."""
    base = _base(spark, sf_dir)
    c = kmeans.init_centroids(base, PARTS, "first")
    for _ in range(2):
        c = kmeans.lloyd_step(base, c)
    rows = [(p, i, float(x)) for p, v in enumerate(c) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "part_id int, pos int, x double").withColumn("x", F.round("x", 5))


@query("SELECT CAST(pos - 1 AS INT) AS pos, round(avg(v), 9) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos")
def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.mean_vector(_base(spark, sf_dir)).select("pos", F.round("mean", 9).alias("mean"))


@query(f"WITH m AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)) SELECT external_id, round(d, 9) AS distance FROM (SELECT vec_id AS external_id, {_ssq('embedding', 'm.m')} AS d FROM embeddings CROSS JOIN m) ORDER BY d, external_id LIMIT 1")
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.medoid(_base(spark, sf_dir)).select("external_id", F.round("distance", 9).alias("distance"))


# Product quantisation; codebook: the sub-vectors of the first CODES vectors

_BOOK = f"SELECT CAST(s AS INT) AS subspace, CAST(vec_id AS INT) AS code, embedding[s * {WIDTH} + 1 : s * {WIDTH} + {WIDTH}] AS centroid FROM embeddings CROSS JOIN range({SUBSPACES}) r(s) WHERE vec_id < {CODES}"
_SUBS = f"SELECT vec_id, CAST(s AS INT) AS subspace, embedding[s * {WIDTH} + 1 : s * {WIDTH} + {WIDTH}] AS sub FROM embeddings CROSS JOIN range({SUBSPACES}) r(s)"
_CODES = f"SELECT vec_id, subspace, code FROM (SELECT v.vec_id, v.subspace, b.code, row_number() OVER (PARTITION BY v.vec_id, v.subspace ORDER BY {_ssq('v.sub', 'b.centroid')}, b.code) AS r FROM ({_SUBS}) v JOIN ({_BOOK}) b ON b.subspace = v.subspace) WHERE r = 1"
_TABLES = f"SELECT v.vec_id AS query_id, v.subspace, b.code, {_ssq('v.sub', 'b.centroid')} AS d FROM ({_SUBS}) v JOIN ({_BOOK}) b ON b.subspace = v.subspace"
_ADC = f"SELECT t.query_id, c.vec_id AS external_id, list_sum(list(t.d ORDER BY c.subspace)) AS distance FROM ({_TABLES}) t JOIN ({_CODES}) c ON c.subspace = t.subspace AND c.code = t.code GROUP BY t.query_id, c.vec_id"
_PAIRS = f"SELECT a.subspace, a.code AS i, b.code AS j, {_ssq('a.centroid', 'b.centroid')} AS d FROM ({_BOOK}) a JOIN ({_BOOK}) b ON a.subspace = b.subspace"
_SYM = f"SELECT q.vec_id AS query_id, c.vec_id AS external_id, list_sum(list(p.d ORDER BY c.subspace)) AS distance FROM ({_CODES}) q JOIN ({_CODES}) c ON c.subspace = q.subspace JOIN ({_PAIRS}) p ON p.subspace = q.subspace AND p.i = q.code AND p.j = c.code GROUP BY q.vec_id, c.vec_id"


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir).where(f"vec_id < {CODES}")
    parts = F.transform(F.sequence(F.lit(0), F.lit(SUBSPACES - 1)), lambda s: F.struct(s.alias("subspace"), F.slice("embedding", s * WIDTH + 1, WIDTH).alias("centroid")))
    return e.select(F.col("vec_id").cast("short").alias("code"), F.explode(parts).alias("p")).select("p.subspace", "code", "p.centroid")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.encode(_base(spark, sf_dir), _book(spark, sf_dir))


@query(_CODES)
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoded(spark, sf_dir).select(F.col("external_id").alias("vec_id"), F.posexplode("codes").alias("subspace", "code"))
    return e.withColumn("code", F.col("code").cast("int"))


@query(f"SELECT vec_id, CAST(subspace * {WIDTH} + p - 1 AS INT) AS pos, x FROM (SELECT c.vec_id, c.subspace, unnest(b.centroid) AS x, generate_subscripts(b.centroid, 1) AS p FROM ({_CODES}) c JOIN ({_BOOK}) b ON b.subspace = c.subspace AND b.code = c.code)")
def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pq.decode(_encoded(spark, sf_dir), _book(spark, sf_dir))
    return d.select(F.col("external_id").alias("vec_id"), F.posexplode("decoded").alias("pos", "x"))


def _rerank_sql(candidates: str, wide: int) -> str:
    return _top(f"SELECT t.query_id, t.external_id, {_ssq('q.embedding', 'e.embedding')} AS distance FROM ({_top(candidates, wide)}) t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings e ON e.vec_id = t.external_id")


@query(_rerank_sql(_ADC, 3 * K))
def pq_adc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 * k by the distances of the queries to the codes, ranked anew by exact distance."""
    return pq.adc_query(_encoded(spark, sf_dir), _book(spark, sf_dir), _queries(spark, sf_dir), K, wide=3 * K)


@query(_rerank_sql(_SYM, 3 * K))
def pq_symmetric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 * k by the distances between codes, ranked anew by exact distance."""
    return pq.symmetric_query(_encoded(spark, sf_dir), _book(spark, sf_dir), _queries(spark, sf_dir), K, wide=3 * K)


_ADC_PROBED = f"SELECT x.query_id, x.external_id, x.distance FROM ({_ADC}) x JOIN ({_ASSIGN}) a ON a.external_id = x.external_id JOIN ({_probe_sql(NPROBE)}) p ON p.query_id = x.query_id AND p.part_id = a.part_id"


@query(_rerank_sql(_ADC_PROBED, 3 * K))
def ivf_pq_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NPROBE of the partitions, 3 * k by codes, ranked anew by exact distance."""
    a = pq.encode(_assigned(spark, sf_dir), _book(spark, sf_dir))
    return pq.ivf_pq_query(a, _centroids(spark, sf_dir), _book(spark, sf_dir), _queries(spark, sf_dir), K, NPROBE, 3.0)


@query(f"SELECT round(avg(e), 9) AS mean_error, round(max(e), 9) AS max_error FROM (SELECT v.vec_id, sum({_ssq('v.sub', 'b.centroid')}) AS e FROM ({_SUBS}) v JOIN ({_CODES}) c ON c.vec_id = v.vec_id AND c.subspace = v.subspace JOIN ({_BOOK}) b ON b.subspace = c.subspace AND b.code = c.code GROUP BY v.vec_id)")
def pq_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.pq_errors(_encoded(spark, sf_dir), _book(spark, sf_dir)).select(F.round("mean_error", 9).alias("mean_error"), F.round("max_error", 9).alias("max_error"))


# Updates and versions: label 1 is replaced at 20, label 2 deleted at 30, label 3 deleted at 40 and back at 50

_LOG = """SELECT vec_id AS external_id, list_reverse(embedding) AS vector, 20 AS ts FROM embeddings WHERE label = 1
UNION ALL SELECT vec_id, CAST([] AS FLOAT[]), 30 FROM embeddings WHERE label = 2
UNION ALL SELECT vec_id, CAST([] AS FLOAT[]), 40 FROM embeddings WHERE label = 3
UNION ALL SELECT vec_id, embedding, 50 FROM embeddings WHERE label = 3"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir)
    none = F.array().cast("array<float>")
    rows = [("label = 1", F.reverse("embedding"), 20), ("label = 2", none, 30), ("label = 3", none, 40), ("label = 3", F.col("embedding"), 50)]
    out = [e.where(w).select(F.col("vec_id").alias("external_id"), v.alias("vector"), F.lit(t).cast("long").alias("ts")) for w, v, t in rows]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _asof_sql(low: int, high: int, base: bool = True) -> str:
    last = f"SELECT external_id, arg_max(vector, ts) AS vector FROM ({_LOG}) WHERE ts BETWEEN {low} AND {high} GROUP BY external_id"
    own = f"SELECT vec_id AS external_id, embedding AS vector FROM embeddings WHERE {'true' if base else 'false'} AND vec_id NOT IN (SELECT external_id FROM ({last}))"
    return f"{own} UNION ALL SELECT external_id, vector FROM ({last}) WHERE len(vector) > 0"


def _view(spark: SparkSession, sf_dir: str, timestamp) -> DataFrame:
    version, low, high = st.resolve([10], timestamp)
    base = _base(spark, sf_dir)
    return st.apply_updates(base if version else base.limit(0), _log(spark, sf_dir).where(F.col("ts").between(low, high)))


def _asof(name: str, timestamp, low: int, high: int, base: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return knn.knn(_view(spark, sf_dir, timestamp), _queries(spark, sf_dir), K)

    run.__doc__ = f"Nearest neighbours in the state as of {timestamp}."
    query(_top(_all(base=_asof_sql(low, high, base))), name)(run)


_asof("updates_merge", None, 11, 1 << 40)
_asof("asof_int", 45, 11, 45)
_asof("asof_range", (15, 35), 15, 35, False)
_asof("asof_from_start", (5, 25), 11, 25)


@query(f"SELECT external_id FROM ({_asof_sql(11, 45)})")
def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that are there after the deletions."""
    return _view(spark, sf_dir, 45).select("external_id")


# Results: recall, padding, merging


@query(f"SELECT CAST(count(*) AS BIGINT) AS hits, count(*) / (SELECT count(*) * {K}.0 FROM embeddings) AS recall FROM (SELECT query_id, external_id FROM ({_ivf_sql(NPROBE)}) INTERSECT SELECT query_id, external_id FROM ({_top(_all())}))")
def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.recall(ivf_query_nprobe12(spark, sf_dir), QUERIES["knn_ssq"](spark, sf_dir), K)


_FEW = _top(_all(where="e.label = 3"), 100)


@query(f"SELECT g.query_id, CAST(g.rank AS INT) AS rank, coalesce(t.external_id, -1) AS external_id, coalesce(t.distance, 3.4028234663852886e38) AS distance FROM (SELECT vec_id AS query_id, r AS rank FROM embeddings CROSS JOIN range(1, 101) x(r)) g LEFT JOIN ({_FEW}) t ON t.query_id = g.query_id AND t.rank = g.rank")
def pad_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 100 rows per query, from fewer vectors."""
    own = knn.vectors(_read(spark, sf_dir).where("label = 3"), "vec_id", "embedding")
    q = _queries(spark, sf_dir)
    return topk.pad_missing(knn.knn(own, q, 100), q, 100)


@query(_top(_all()))
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of two overlapping parts of the table, merged."""
    q, e = _queries(spark, sf_dir), _read(spark, sf_dir)
    return topk.merge_top_k([knn.knn(knn.vectors(e.where(w), "vec_id", "embedding"), q, K) for w in ("label < 6", "label > 3")], K)


# Graphs

_EDGES = f"SELECT query_id AS src, external_id AS dst, distance AS score FROM ({_top(_all(where='q.vec_id <> e.external_id'), 5)})"


@query(_EDGES)
def knn_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.knn_graph(_base(spark, sf_dir), 5)


_BFS = f"WITH RECURSIVE e AS ({_EDGES}), b(node, level) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, min(b.level) + 1 FROM b JOIN e ON e.src = b.node LEFT JOIN recurring.b r ON r.node = e.dst WHERE r.node IS NULL GROUP BY e.dst) SELECT node, CAST(level AS INT) AS level FROM b"


@query(_BFS)
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from vector 0 over the graph of five neighbours to every vector that can be reached."""
    return graph.bfs(cut(graph.knn_graph(_base(spark, sf_dir), 5)), [0])


@query(f"SELECT src, dst, score + 1 AS score FROM ({_EDGES}) e JOIN embeddings v ON v.vec_id = e.src WHERE v.label = 3")
def graph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose stored score is not their ends' distance: those that were falsified, from vectors of label 3."""
    g, own = graph.knn_graph(_base(spark, sf_dir), 5), _read(spark, sf_dir).select(F.col("vec_id").alias("src"), "label")
    g = g.join(own, "src").select("src", "dst", F.when(F.col("label") == 3, F.col("score") + 1).otherwise(F.col("score")).alias("score"))
    return graph.invalid_edges(g, _base(spark, sf_dir))


@query()
def vamana_query_L100(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    base = _base(spark, sf_dir)
    return graph.vamana_query(cut(graph.build_vamana(base, shards=max(1, -(-base.count() // graph.SHARD_ROWS)))), _queries(spark, sf_dir), K)


@query()
def nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An approximate graph of ten neighbours."""
    return graph.nn_descent(_base(spark, sf_dir), 10)


# Indexes from end to end, in the shared folder


def _index(spark: SparkSession, sf_dir: str, kind: str, **options):
    import uuid

    from .operators.cut import shared_dir

    return ingest(spark, kind, f"{shared_dir(spark)}/vexel-index-{uuid.uuid4().hex}", input_vectors=_base(spark, sf_dir), **options)


@query(_top(_all()))
def index_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, "FLAT").query(_queries(spark, sf_dir), K)


@query(_top(_all()))
def index_ivf_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partitions are probed: exact."""
    return _index(spark, sf_dir, "IVF_FLAT", partitions=8).query(_queries(spark, sf_dir), K, nprobe=8)


@query(_top(_all()))
def index_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partitions are probed and all candidates ranked anew: exact."""
    n = _read(spark, sf_dir).count()
    return _index(spark, sf_dir, "IVF_PQ", partitions=8, num_subspaces=SUBSPACES).query(_queries(spark, sf_dir), K, nprobe=8, k_factor=n / K)


@query(_top(_all()))
def vamana_query_exact_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk as wide as the table: exact, as every vector can be reached."""
    n = _read(spark, sf_dir).count()
    return _index(spark, sf_dir, "VAMANA", l_build=40, r_max_degree=16).query(_queries(spark, sf_dir), K, l_search=n)


@query(_top(_all(base="SELECT vec_id AS external_id, embedding AS vector FROM embeddings WHERE label <> 0 UNION ALL SELECT vec_id + 1000000, list_reverse(embedding) FROM embeddings WHERE label = 0")))
def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of label 0 are deleted and put in again, reversed, under other ids; then consolidated."""
    index = _index(spark, sf_dir, "IVF_FLAT", partitions=8, index_timestamp=10)
    own = _read(spark, sf_dir).where("label = 0")
    index.delete_batch(own.select(F.col("vec_id").alias("external_id")), 20)
    index.update_batch(own.select((F.col("vec_id") + 1_000_000).alias("external_id"), F.reverse("embedding").alias("vector")), 30)
    return index.consolidate_updates().query(_queries(spark, sf_dir), K, nprobe=8)


# Sources and objects


@query("SELECT vec_id AS external_id, CAST(p - 1 AS INT) AS pos, x FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN x ELSE 0 END)) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)")
def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors rebuilt from their positive elements as (row, column, value)."""
    cells = _read(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("c", "v")).where("v > 0")
    d = coo_to_vectors(cells, "vec_id", "c", "v", 64)
    return d.select("external_id", F.posexplode("vector").alias("pos", "x"))


_EVEN = _top(_all(where="e.label % 2 = 0")).replace("SELECT query_id", "SELECT t.label, query_id", 1).replace("WHERE rank <=", "JOIN (SELECT vec_id AS id, label FROM embeddings) t ON t.id = external_id WHERE rank <=")


def _object_index(spark: SparkSession, sf_dir: str, kind: str = "IVF_FLAT") -> ObjectIndex:
    """An object index over the embeddings' table: vectors are given, the label is an attribute."""
    import uuid

    from .operators.cut import shared_dir

    reader = TableReader(f"{sf_dir}/embeddings.parquet", "vec_id", ["label"])
    index = ObjectIndex.create(spark, f"{shared_dir(spark)}/vexel-objects-{uuid.uuid4().hex}", kind, reader, ColumnEmbedding(64, "embedding"))
    index.update_index(**({"partitions": 8} if kind == "IVF_FLAT" else {}))
    return index


@query(_EVEN)
def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object index asked for objects with an even label, with their attributes: filtered before the search."""
    index = _object_index(spark, sf_dir)
    objects = index.reader.objects(spark)
    return index.query(objects, K, where="label % 2 = 0", return_metadata=True, nprobe=8).select("label", *topk.RESULT)


@query(_EVEN)
def metadata_filter_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metadata_join with a Python predicate on the attributes, applied to what was found."""
    index = _object_index(spark, sf_dir, "FLAT")
    return index.query(index.reader.objects(spark), K, filter_fn=lambda r: r["label"] % 2 == 0, filter_mode="post", return_metadata=True).select("label", *topk.RESULT)


_MULTI = f"""WITH f AS (SELECT query_id AS embedding_id, CAST(query_id // 4 AS BIGINT) AS query_id, CAST(external_id // 4 AS BIGINT) AS external_id, rank FROM ({_top(_all())})),
s AS (SELECT embedding_id, query_id, external_id, max(1 - (rank - 1) / n) AS score FROM (SELECT *, max(rank) OVER (PARTITION BY embedding_id) AS n FROM f) GROUP BY ALL),
m AS (SELECT query_id, external_id, round(sum(score), 9) AS score FROM s GROUP BY query_id, external_id)
{_top("SELECT * FROM m", by="score", desc=True)}"""


@query(_MULTI)
def multi_embedding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors make an object: each query vector's best hit per object, summed up per query object."""
    found = QUERIES["knn_ssq"](spark, sf_dir)
    found = found.select(F.col("query_id").alias("embedding_id"), F.floor(F.col("query_id") / 4).alias("query_id"), F.floor(F.col("external_id") / 4).alias("external_id"), "rank", "distance")
    return merge_per_object(found, K, per_query=lambda c: F.round(F.sum(c), 9))


@query("SELECT d.doc_id, d.lang, length(d.text) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1")
def object_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of given ids, by the reader."""
    ids = _read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("external_id"))
    got = TableReader(f"{sf_dir}/documents.parquet", "doc_id").by_ids(spark, ids)
    return got.select("doc_id", "lang", F.length("text").cast("long").alias("n"))


# Binary files: written from the embeddings and read back; position i holds vec_id i


def _file(kind: str, value: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import uuid

        from .operators.cut import shared_dir

        path = f"{shared_dir(spark)}/vexel-{uuid.uuid4().hex}.{kind}"
        write_vectors(_read(spark, sf_dir).select(F.col("vec_id").alias("external_id"), F.expr(value).alias("vector")), path)
        d = read_vectors(spark, path, range_bytes=20_000)
        return d.select("external_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))

    run.__doc__ = f"The embeddings by way of a {kind} file."
    query(f"SELECT vec_id AS external_id, CAST(p - 1 AS INT) AS pos, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest({sql}) AS x, generate_subscripts({sql}, 1) AS p FROM embeddings)", f"source_{kind}")(run)


for _kind in ("fvecs", "f32bin"):
    _file(_kind, "embedding", "embedding")
for _kind, _type in (("ivecs", "int"), ("i8bin", "tinyint")):
    _file(_kind, f"transform(embedding, x -> cast(floor(x * 100) AS {_type}))", "list_transform(embedding, lambda x: floor(x::DOUBLE * 100))")
    QUERIES[f"source_{_kind}"].__doc__ += " Elements are hundredths."
for _kind in ("bvecs", "u8bin"):
    _file(_kind, "transform(embedding, x -> cast(floor(abs(x) * 100) AS smallint))", "list_transform(embedding, lambda x: floor(abs(x)::DOUBLE * 100))")


@query("SELECT CAST(vec_id AS BIGINT) AS pos, CAST(vec_id * 3 + 7 AS BIGINT) AS external_id FROM embeddings")
def source_u64bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids by way of a u64bin file."""
    import uuid

    from .operators.cut import shared_dir

    path = f"{shared_dir(spark)}/vexel-{uuid.uuid4().hex}.u64bin"
    write_vectors(_read(spark, sf_dir).select(F.col("vec_id").alias("external_id"), F.array(F.col("vec_id") * 3 + 7).alias("vector")), path)
    return read_ids(spark, path)


# Trained searches: no SQL has the centroids; tests hold them against exact search


def _ivf_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    return kmeans.kmeans_fit(base, PARTS, "k-means++", 10, seed=1)


@query()
def ivf_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every vector by an inverted file with trained centroids (k-means++, ten rounds over the whole table), 12 of 16 partitions probed."""
    base = _base(spark, sf_dir)
    c = cut(_ivf_trained(spark, sf_dir))
    return ivf.ivf_query(kmeans.assign(base, c), c, _queries(spark, sf_dir), K, 12)


@query()
def ivf_pq_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every vector by trained codes (16 subspaces of 256), 12 of 16 partitions probed, five times as many ranked anew by exact distance."""
    base = _base(spark, sf_dir)
    c, book = cut(_ivf_trained(spark, sf_dir)), cut(pq.train_pq(base, 16))
    return pq.ivf_pq_query(pq.encode(kmeans.assign(base, c), book), c, book, _queries(spark, sf_dir), K, 12, 5.0)


@query()
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents nearest to each benchmark item, by hashed words."""
    from .objects.embeddings import HashingEmbedding
    from .objects.index import embed

    e = HashingEmbedding(64)
    docs = embed(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("external_id"), "text"), e)
    items = embed(_read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("external_id"), "text"), e)
    return knn.knn(docs, items.withColumnRenamed("external_id", "query_id"), K, Metric.COSINE)


