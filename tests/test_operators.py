import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import Metric
from vexel.functions import kernels as kn
from vexel.operators import graph, ivf, kmeans, knn, pq, topk


def frame(spark, x, first=0, name="external_id"):
    return spark.createDataFrame([(i + first, v.astype(np.float32).tolist()) for i, v in enumerate(x)], f"{name} long, vector array<float>")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 5
    x = (centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16))).astype(np.float32)
    q = (centres[rng.integers(0, 12, 25)] + rng.normal(size=(25, 16))).astype(np.float32)
    return x, q, frame(spark, x).repartition(4).cache(), frame(spark, q, 0, "query_id").cache()


def truth(x, q, k, metric):
    out = {}
    for i, v in enumerate(q.astype(float)):
        d = kn.exact(metric, np.repeat(v[None], len(x), 0), x.astype(float))
        order = np.lexsort((np.arange(len(x)), -d if metric.descending else d))[:k]
        out[i] = [(int(j), float(d[j])) for j in order]
    return out


def as_dict(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.external_id, r.distance))
    return out


@pytest.mark.parametrize("metric", list(Metric))
def test_knn_plans_agree_with_brute_force(spark, blobs, metric):
    x, q, base, queries = blobs
    want = truth(x, q, 7, metric)
    assert as_dict(knn.knn(base, queries, 7, metric)) == want
    assert as_dict(knn.knn(base, queries, 7, metric, broadcast_bytes=0)) == want
    assert as_dict(knn.knn_expr(base, queries, 7, metric)) == want


def test_knn_edges(spark, blobs):
    x, q, base, queries = blobs
    assert knn.knn(base.limit(0), queries, 3).count() == 0
    assert knn.knn(base, queries.limit(0), 3).count() == 0
    few = knn.knn(base.limit(2), queries, 5)
    assert few.count() == 2 * 25
    padded = topk.pad_missing(few, queries, 5)
    assert padded.count() == 125 and padded.where("external_id = -1").count() == 75
    assert topk.trim(padded).count() == 50
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in (9, 4, 7)], "external_id long, vector array<float>")
    got = knn.knn(same, spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, vector array<float>"), 2)
    assert [r.external_id for r in got.orderBy("rank").collect()] == [4, 7]
    with pytest.raises(ValueError):
        knn.knn(base, queries, 0)


def test_plan_keeps_queries_small(blobs):
    _, _, base, queries = blobs
    plan = knn.knn(base, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_radius_and_merge(spark, blobs):
    x, q, base, queries = blobs
    got = {(r.query_id, r.external_id) for r in knn.radius_search(base, queries, 5.0).collect()}
    assert got == {(i, j) for i in range(25) for j in range(600) if np.sqrt(((x[j].astype(float) - q[i]) ** 2).sum()) <= 5}
    whole = knn.knn(base, queries, 6)
    parts = [knn.knn(base.where(c), queries, 6) for c in ("external_id < 300", "external_id >= 250")]
    merged = topk.merge_top_k(parts, 6)
    assert as_dict(merged) == as_dict(whole)
    assert topk.validate_top_k(merged, whole) and not topk.validate_top_k(merged.where("rank < 6"), whole)
    assert topk.recall(whole.where("rank <= 3"), whole, 6).first().recall == 0.5


def test_ivf(spark, blobs):
    x, q, base, queries = blobs
    c = kmeans.kmeans_fit(base, 10, max_iter=5, seed=3)
    a = kmeans.assign(base, c).cache()
    cm = kmeans.centroid_matrix(c)
    want = ((x[:, None].astype(float) - cm) ** 2).sum(2).argmin(1)
    assert {r.external_id: r.part_id for r in a.collect()} == dict(enumerate(want.tolist()))
    assert as_dict(ivf.ivf_query(a, c, queries, 5, 10)) == truth(x, q, 5, Metric.SUM_OF_SQUARES)
    one, two = (as_dict(ivf.ivf_query(a, c, queries, 5, 3, Metric.L2, n)) for n in (knn.BROADCAST_BYTES, 0))
    assert one == two
    sizes = {r.part_id: r.size for r in kmeans.partition_sizes(a).collect()}
    at = 0
    for r in kmeans.partition_offsets(a).orderBy("part_id").collect():
        assert r.size == sizes[r.part_id] and r.start == at
        at += r.size
    probes = ivf.probe(queries, c, 3)
    assert probes.count() == 75 and ivf.active_partitions(probes).agg(F.sum("queries")).first()[0] == 75


def test_kmeans_quality_and_starts(spark, blobs):
    x, _, base, _ = blobs
    def cost(c):
        return ((x[:, None].astype(float) - kmeans.centroid_matrix(c)) ** 2).sum(2).min(1).mean()
    good = min(((x[:, None].astype(float) - kn.lloyd(x.astype(float), kn.kmeans_pp(x.astype(float), 12, s), 50)) ** 2).sum(2).min(1).mean() for s in range(5))
    assert cost(kmeans.kmeans_fit(base, 12, "k-means++", 20, seed=1)) < 1.5 * good
    assert cost(kmeans.kmeans_fit(base, 12, "k-means++", 20, seed=1, sample_size=400)) < 1.5 * good
    first = kmeans.centroid_table(spark, kmeans.init_centroids(base, 12, "first"))
    assert kmeans.centroid_matrix(first).tolist() == x[:12].astype(float).tolist()
    assert cost(kmeans.kmeans_fit(base, 12, "first", 20)) < cost(first)
    few = kmeans.kmeans_fit(base.limit(3), 5, "first", 2)
    assert few.count() == 5
    m = kmeans.medoid(base).first()
    d = ((x.astype(float) - x.astype(float).mean(0)) ** 2).sum(1)
    assert m.external_id == d.argmin() and abs(m.distance - d.min()) < 1e-6
    with pytest.raises(ValueError):
        kmeans.init_centroids(base, 3, "other")
    moved = kn.lloyd(np.array([[0.0], [0.1], [5.0], [5.1], [9.0]]), np.array([[0.0], [5.0], [100.0]]), 5, 0, reassign=0.05)
    assert 100.0 not in moved


def test_sample_is_the_least_hashes(spark):
    d = spark.range(20_000).select(F.col("id").alias("external_id"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    want = [r.external_id for r in d.orderBy(F.xxhash64("external_id", F.lit(3)), "external_id").limit(50).collect()]
    assert [r.external_id for r in kmeans.sample(d, 50, "RANDOM", 3).collect()] == want
    assert sorted(r.external_id for r in kmeans.sample(d, 5, "FIRST_N").collect()) == [0, 1, 2, 3, 4]
    assert kmeans.sample(d, 30_000).count() == 20_000


def test_pq(spark, blobs):
    x, q, base, queries = blobs
    book = pq.train_pq(base, 4, clusters=32, seed=2).cache()
    e = pq.encode(base, book).cache()
    cb = pq.codebook_array(book)
    xs = x.astype(float).reshape(len(x), 4, 4)
    codes = ((xs[:, :, None] - cb[None]) ** 2).sum(3).argmin(2)
    rows = pq.decode(e, book).collect()
    for r in rows:
        assert r.codes == codes[r.external_id].tolist()
        assert np.allclose(r.decoded, np.concatenate([cb[s][c] for s, c in enumerate(r.codes)]))
    dec = np.stack([cb[np.arange(4), c].ravel() for c in codes])
    got = as_dict(pq.adc_query(e, book, queries, 5))
    for i in range(25):
        d = ((dec - q[i]) ** 2).sum(1)
        assert np.allclose([v for _, v in got[i]], np.sort(d)[:5])
    sym = as_dict(pq.symmetric_query(e, book, queries, 5, Metric.L2))
    qd = np.stack([cb[np.arange(4), c].ravel() for c in ((q.astype(float).reshape(25, 4, 4)[:, :, None] - cb[None]) ** 2).sum(3).argmin(2)])
    for i in range(25):
        assert np.allclose([v for _, v in sym[i]], np.sqrt(np.sort(((dec - qd[i]) ** 2).sum(1))[:5]))
    c = kmeans.kmeans_fit(base, 8, max_iter=3)
    a = pq.encode(kmeans.assign(base, c), book)
    assert as_dict(pq.ivf_pq_query(a, c, book, queries, 5, 8, k_factor=120.0)) == truth(x, q, 5, Metric.SUM_OF_SQUARES)
    assert as_dict(pq.ivf_pq_query(a, c, book, queries, 5, 8)) == got
    full = pq.train_pq(base.limit(200), 2)
    assert pq.pq_errors(pq.encode(base.where("external_id >= 0").join(base.limit(200).select("external_id"), "external_id", "left_semi"), full), full).first().mean_error < 1e3
    small = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0, float(i % 3)]) for i in range(256)], "external_id long, vector array<float>")
    b = pq.train_pq(small, 2)
    assert pq.pq_errors(pq.encode(small, b), b).first().max_error < 1e-9
    with pytest.raises(ValueError):
        pq.check_subspaces(16, 5)
    with pytest.raises(ValueError):
        pq.ivf_pq_query(a, c, book, queries, 5, 8, k_factor=0.5)


def test_vamana_and_graphs(spark, blobs):
    x, q, base, queries = blobs
    want = truth(x, q, 10, Metric.SUM_OF_SQUARES)
    for shards in (1, 3):
        g = graph.build_vamana(base, l_build=40, r_max_degree=16, shards=shards).cache()
        assert as_dict(graph.vamana_query(g, queries, 10, l_search=600)) == want
        got = as_dict(graph.vamana_query(g, queries, 10, l_search=50))
        assert sum(len({i for i, _ in got[j]} & {i for i, _ in want[j]}) for j in want) >= 0.9 * 250
    start = [r.external_id for r in graph.build_vamana(base, 40, 16).where("start").collect()]
    levels = graph.bfs(graph.edges(graph.build_vamana(base, 40, 16)), start)
    assert levels.count() == 600
    e = graph.knn_graph(base, 5)
    assert e.count() == 3000 and graph.invalid_edges(e, base).count() == 0
    assert graph.invalid_edges(e.withColumn("score", F.col("score") + 1), base).count() == 3000
    n = graph.nn_descent(base, 8, rounds=4, seed=1)
    exact = graph.knn_graph(base, 8)
    assert n.join(exact, ["src", "dst"], "left_semi").count() > 0.8 * 4800
    got = as_dict(graph.nn_descent_query(n, base, queries, 10, seeds=64))
    assert sum(len({i for i, _ in got[j]} & {i for i, _ in want[j]}) for j in got) >= 0.7 * 250


def test_bfs_levels(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(0, 4), (9, 0)], "src long, dst long")
    assert {r.node: r.level for r in graph.bfs(e, [0]).collect()} == {0: 0, 1: 1, 4: 1, 2: 2, 5: 2, 3: 3, 6: 3}
    assert {r.node for r in graph.bfs(e, [0], 1).collect()} == {0, 1, 4}


def test_large_query_sets_give_the_rows_of_small_ones(spark, blobs):
    _, _, base, queries = blobs
    book = pq.train_pq(base, 4, clusters=32)
    cent = kmeans.kmeans_fit(base, 6, max_iter=3)
    encoded = pq.encode(kmeans.assign(base, cent), book).cache()
    for f in (lambda b: pq.adc_query(encoded, book, queries, 5, broadcast_bytes=b), lambda b: pq.symmetric_query(encoded, book, queries, 5, broadcast_bytes=b), lambda b: pq.ivf_pq_query(encoded, cent, book, queries, 5, 3, 4.0, broadcast_bytes=b)):
        small, large = as_dict(f(knn.BROADCAST_BYTES)), as_dict(f(500))
        assert small == large and len(small) == 25


def test_kmeans_over_a_sample_too_large_for_the_driver(spark, blobs):
    x, _, base, _ = blobs
    a = kmeans.centroid_matrix(kmeans.kmeans_fit(base, 12, "k-means++", 20, seed=3, sample_size=500))
    b = kmeans.centroid_matrix(kmeans.kmeans_fit(base, 12, "k-means++", 20, seed=3, sample_size=500, driver_bytes=0))
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).min(1).mean()
    assert cost(b) < 1.5 * cost(a) + 1


def test_distributed_kmeans_reassigns_small_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(400, 2)), [[1000.0, 1000.0]]]).astype(np.float32)
    base = frame(spark, x, 0)
    start = {r.part_id: r.size for r in kmeans.partition_sizes(kmeans.assign(base, kmeans.kmeans_fit(base, 5, "k-means++", 8, seed=1))).collect()}
    again = {r.part_id: r.size for r in kmeans.partition_sizes(kmeans.assign(base, kmeans.kmeans_fit(base, 5, "k-means++", 8, seed=1, reassign=0.1))).collect()}
    assert min(start.values()) == 1 and sum(again.values()) == 401 and sorted(again.values()) != sorted(start.values())


def test_nn_descent_query_in_shards(spark, blobs):
    x, q, base, queries = blobs
    g = graph.knn_graph(base, 12).cache()
    want = truth(x, q, 5, Metric.SUM_OF_SQUARES)
    for rows in (1 << 20, 200):
        got = as_dict(graph.nn_descent_query(g, base, queries, 5, l_search=80, seeds=60, shard_rows=rows))
        assert sum(len({i for i, _ in got[k]} & {i for i, _ in want[k]}) for k in want) >= 0.9 * 125


def test_a_folder_for_tables_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from vexel.operators.cut import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://x/y/"}, sparkContext=context)) == "hdfs://x/y"


@pytest.mark.parametrize("metric", list(Metric))
def test_running_top_k_over_odd_vectors(metric):
    rng = np.random.default_rng(0)
    plain = rng.normal(size=(600, 16))
    odd = plain.copy()
    odd[3, 2], odd[7, 1] = np.nan, np.inf
    for x in (plain, plain + 1000, np.repeat(plain[:20], 30, 0), plain * 1e25, plain * 1e-25, odd, plain[:5]):
        q, ids = x[:40], rng.permutation(len(x))
        near = kn.Nearest(metric, q, 7)
        with np.errstate(all="ignore"):
            for s in range(0, len(x), 100):
                near.add(x[s : s + 100], ids[s : s + 100])
            row, found, d = near.result()
            want = np.concatenate([kn.exact(metric, np.repeat(v[None], len(x), 0), x) for v in q])
        own, every = np.repeat(np.arange(len(q)), len(x)), np.tile(ids, len(q))
        at = kn.best(metric, own, every, want, 7)
        assert np.array_equal(own[at], row) and np.array_equal(every[at], found) and np.array_equal(want[at], d, equal_nan=True)


def test_a_large_search_sends_k_rows_a_query_whatever_the_base(spark, blobs):
    """Before, every pair of blocks sent k rows a query, and joins on part_id or of column expressions all pairs."""
    x, q, _, queries = blobs
    base = frame(spark, np.tile(x, (15, 1))).repartition(5)
    assert knn.block_top_k(base, queries, 7, Metric.L2).count() == 25 * 7
    c = kmeans.kmeans_fit(base, 6, max_iter=2)
    a = kmeans.assign(base, c)
    assert ivf.block_probe(a, kmeans.centroid_matrix(c), queries, 7, 4, Metric.L2).count() == 25 * 7
    book = pq.train_pq(base, 4, clusters=16)
    for f in (lambda b: knn.knn(base, queries, 7, broadcast_bytes=b), lambda b: ivf.ivf_query(a, c, queries, 7, 4, broadcast_bytes=b)):
        assert as_dict(f(0)) == as_dict(f(knn.BROADCAST_BYTES))
    plan = ivf.ivf_query(a, c, queries, 7, 4, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "part_id" in plan and "zip_with" not in plan
    e = pq.encode(a, book)
    assert as_dict(pq.ivf_pq_query(e, c, book, queries, 5, 4, k_factor=len(x) * 15 / 5)) == as_dict(ivf.ivf_query(a, c, queries, 5, 4))


def test_ranked_anew_gives_the_rows_of_the_join(spark, blobs):
    _, _, base, queries = blobs
    book = pq.train_pq(base, 4, clusters=16)
    e = pq.encode(base, book)
    for f in (pq.adc_query, pq.symmetric_query):
        assert as_dict(f(e, book, queries, 5, wide=20)) == as_dict(pq.rerank(f(e, book, queries, 20), base, queries, 5))


def test_walks_side_by_side(spark, blobs):
    """Before, one task walked for one query after another, and a walk as wide as the table went on from every vector."""
    from time import perf_counter

    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32))
    nbrs, medoid = kn.vamana(x, 24, 60, 1.2, Metric.SUM_OF_SQUARES)
    assert max(map(len, nbrs)) <= 30 and all(len(set(v.tolist())) == len(v) and i not in v for i, v in enumerate(nbrs))
    g = kn.Graph.of(Metric.SUM_OF_SQUARES, x, np.repeat(np.arange(len(x)), [len(v) for v in nbrs]), np.concatenate(nbrs))
    q = rng.normal(size=(64, 32))
    together = g.walk(g.place(q), np.array([medoid]), 60)[0]
    for i in range(0, 64, 9):
        assert set(g.walk(g.place(q[i : i + 1]), np.array([medoid]), 60)[0][0]) == set(together[i])
    want = [v for v in truth(x, q, 10, Metric.SUM_OF_SQUARES).values()]
    assert sum(len({j for j, _ in w} & set(f)) for w, f in zip(want, together)) >= 0.95 * 640
    base, many = frame(spark, x), frame(spark, rng.normal(size=(2500, 32)), 0, "query_id")
    built = graph.build_vamana(base, 20, 8, shards=2).cache()
    assert built.count() == 1500
    began = perf_counter()
    got = graph.vamana_query(built, many, 5, l_search=1500)
    assert got.count() == 5 * 2500 and perf_counter() - began < 30
    assert as_dict(got) == as_dict(knn.knn(base, many, 5))


def test_nn_descent_in_passes(spark, blobs):
    """Before, all pairs of a list's members went through a shuffle; now only what can enter another's list leaves a task, whatever the number of passes."""
    x, _, base, _ = blobs
    one, many = ({(r.src, r.dst, r.score) for r in graph.nn_descent(base, 5, rounds=2, seed=1, pass_bytes=b).collect()} for b in (1 << 30, 1 << 20))
    assert one == many and len(one) == 5 * 600
    import pyarrow as pa

    ids = np.arange(60)
    bound = np.full(60, 40.0)
    t = pa.table({"mid": np.repeat([7, 9], 30), "member": ids, "vector": pa.array(list(x[:60]), pa.list_(pa.float32())), "bound": bound})
    got = graph._within_lists(t, 4)
    want = set()
    for lo in (0, 30):
        for a in range(lo, lo + 30):
            d = sorted((float(((x[a].astype(float) - x[b]) ** 2).sum()), b) for b in range(lo, lo + 30) if a != b)[:4]
            want |= {(a, b) for s, b in d if s <= 40.0}
    assert set(zip(got["src"].to_pylist(), got["dst"].to_pylist())) == want and 0 < len(want) < 240
