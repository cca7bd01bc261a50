import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import MAX_FLOAT32, Metric
from vexel.plans import create, delete_index, ingest, open_index
from vexel.plans.ingest import auto_partitions, auto_sample
from vexel.plans.store import MAX_TS, resolve

NONE = (1 << 64) - 1
KINDS = {"FLAT": {}, "IVF_FLAT": {"partitions": 3}, "VAMANA": {"l_build": 20, "r_max_degree": 8}, "IVF_PQ": {"partitions": 3, "num_subspaces": 2}}


def find(index, q, k, **options):
    d, i = index.query_matrix(np.array([q], np.float32), k, **options)
    return i[0].tolist(), d[0].tolist()


@pytest.mark.parametrize("kind", KINDS)
def test_five_points_updates_and_consolidation(spark, tmp_path, kind):
    uri = str(tmp_path / "i")
    x = np.array([[i] * 4 for i in range(5)], np.float32)
    index = ingest(spark, kind, uri, input_vectors=x, index_timestamp=10, **KINDS[kind])
    options = {"nprobe": 3} if kind.startswith("IVF") else {}
    q = [2, 2, 2, 2]
    assert sorted(find(index, q, 3, **options)[0]) == [1, 2, 3]
    assert find(index, q, 2, **options) == ([2, 1], [0.0, 4.0])
    index.delete_batch(spark.createDataFrame([(1,), (3,)], "external_id long"), 20)
    assert sorted(find(index, q, 3, **options)[0]) == [0, 2, 4]
    index.update_batch(spark.createDataFrame([(1, [1.0] * 4), (3, [3.0] * 4)], "external_id long, vector array<float>"), 30)
    assert sorted(find(index, q, 3, **options)[0]) == [1, 2, 3]
    index.delete(2, 40)
    index.update(1 << 63 | 7, [2.0, 2.0, 2.0, 2.5], 41)
    assert find(index, q, 1, **options)[0] == [1 << 63 | 7]
    index.consolidate_updates()
    assert index.version == 42 and index.size == 5 and not index.has_updates
    assert find(index, q, 1, **options)[0] == [1 << 63 | 7]
    assert 2 not in find(index, q, 6, **options)[0]
    old = open_index(spark, uri, 25)
    assert sorted(find(old, q, 3, **options)[0]) == [0, 2, 4]
    index.clear_history(41)
    assert index.meta["ingestion_timestamps"] == [42] and find(open_index(spark, uri, 25), q, 1)[0] == [NONE]
    index.vacuum()
    assert find(open_index(spark, uri), q, 1, **options)[0] == [1 << 63 | 7]
    delete_index(spark, uri)
    delete_index(spark, uri)
    with pytest.raises(FileNotFoundError):
        open_index(spark, uri)


def test_history_table():
    h = [10, 20]
    assert resolve(h, None) == (20, 21, MAX_TS)
    assert resolve(h, 15) == (10, 11, 15) and resolve(h, 20) == (20, 21, 20)
    assert resolve(h, 9) == (None, 1, 0)
    assert resolve(h, (11, 30)) == (None, 11, 30) and resolve(h, (11, None)) == (None, 11, MAX_TS)
    assert resolve(h, (5, 15)) == (10, 11, 15) and resolve(h, (None, None)) == (10, 11, MAX_TS)
    assert resolve(h, (5, 9)) == (None, 1, 0) and resolve([], None) == (None, 0, MAX_TS)
    for bad, error in (((1, 2, 3), ValueError), ("x", TypeError), (True, TypeError)):
        with pytest.raises(error):
            resolve(h, bad)


def test_time_travel(spark, tmp_path):
    uri = str(tmp_path / "i")
    x = np.array([[1.0, 1.1, 1.2, 1.3], [2.0, 2.1, 2.2, 2.3]], np.float32)
    ingest(spark, "IVF_FLAT", uri, input_vectors=x, index_timestamp=10, partitions=1)
    third = np.array([[3.0, 3.1, 3.2, 3.3]], np.float32)
    ingest(spark, "IVF_FLAT", uri, input_vectors=np.vstack([x, third]), index_timestamp=20, partitions=1)
    for ts in (0, 9, (5, 9), (None, 9)):
        assert find(open_index(spark, uri, ts), x[1], 1) == ([NONE], [np.float32(MAX_FLOAT32)])
    for ts in (10, 1000, (5, 15), (None, 20)):
        assert find(open_index(spark, uri, ts), x[1], 1) == ([1], [0.0])
    assert find(open_index(spark, uri, 19), third[0], 1)[0] == [1] and find(open_index(spark, uri), third[0], 1)[0] == [2]
    with pytest.raises(ValueError, match="not after"):
        ingest(spark, "IVF_FLAT", uri, input_vectors=x, index_timestamp=20)
    index = open_index(spark, uri)
    with pytest.raises(ValueError, match="not after"):
        index.update(5, x[0], 20)
    for i, ts in enumerate((30, 40, 50)):
        index.update(100 + i, [10.0 + i] * 4, ts)
    seen = lambda ts: sorted(r.external_id for r in open_index(spark, uri, ts).vectors().collect())
    assert seen(None) == [0, 1, 2, 100, 101, 102] and seen(40) == [0, 1, 2, 100, 101] and seen((35, 45)) == [101]
    assert seen((0, 45)) == [0, 1, 100, 101] and seen(29) == [0, 1, 2]


def test_empty_index_padding_and_validation(spark, tmp_path):
    index = create(spark, str(tmp_path / "e"), "FLAT", 3)
    assert find(index, [1, 2, 3], 2) == ([NONE, NONE], [np.float32(MAX_FLOAT32)] * 2)
    q = np.zeros((1, 3), np.float32)
    assert index.query(q, 4, pad=True).count() == 4 and index.query(q, 4).count() == 0
    index.update(7, [1, 2, 3])
    assert find(index, [1, 2, 3], 1) == ([7], [0.0])
    for bad, error in ((np.zeros((1, 4), np.float32), ValueError), (np.zeros(3, np.float32), ValueError), (np.zeros((1, 3)), TypeError)):
        with pytest.raises(error):
            index.query(bad, 1)
    with pytest.raises(ValueError):
        index.query(q, 0)
    with pytest.raises(ValueError):
        index.update(8, [1, 2])
    with pytest.raises(ValueError):
        create(spark, str(tmp_path / "e"), "FLAT", 3)
    with pytest.raises(ValueError):
        create(spark, str(tmp_path / "f"), "IVF_PQ", 9, num_subspaces=2)
    with pytest.raises(ValueError):
        create(spark, str(tmp_path / "f"), "VAMANA", 9, storage_version="0.2")


def test_arguments(spark, tmp_path):
    x, uri = np.zeros((3, 2), np.float32), str(tmp_path / "i")
    for bad in (
        {}, {"input_vectors": x, "source_uri": "u"}, {"input_vectors": x, "source_type": "fvecs"}, {"input_vectors": x, "external_ids": [1, 2, 3], "external_ids_uri": "u"}, {"input_vectors": x, "training_sampling_policy": "NEWEST"},
        {"input_vectors": x, "copy_centroids_uri": "u"}, {"input_vectors": x, "copy_centroids_uri": "u", "partitions": 2, "training_sample_size": 5}, {"input_vectors": x, "external_ids": [1]}, {"input_vectors": x, "distance_metric": "INNER_PRODUCT"},
    ):
        with pytest.raises(ValueError):
            ingest(spark, "IVF_FLAT", uri, **bad)
    with pytest.raises(ValueError):
        ingest(spark, "FLAT", uri, input_vectors=x, partitions=2)
    assert auto_partitions(0) == 1 and auto_partitions(10**9) == 10_000 and auto_partitions(101) == 10
    assert auto_sample(50, 8, 10) == 50 and auto_sample(10**9, 128, 10_000) == 1_000_000


def test_metrics_filters_and_training(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    q = rng.normal(size=(10, 8)).astype(np.float32)
    ids = np.arange(400, dtype=np.uint64) + 1000
    flat = {m: ingest(spark, "FLAT", str(tmp_path / f"f{m}"), input_vectors=x, external_ids=ids, distance_metric=m) for m in Metric}
    for m in (Metric.SUM_OF_SQUARES, Metric.L2, Metric.COSINE):
        d, i = flat[m].query_matrix(q, 5)
        ivf = ingest(spark, "IVF_FLAT", str(tmp_path / f"i{m}"), input_vectors=x, external_ids=ids, distance_metric=m, training_sampling_policy="RANDOM", training_sample_size=200)
        d2, i2 = ivf.query_matrix(q, 5, nprobe=20)
        assert (i == i2).all() and np.allclose(d, d2, atol=1e-5)
        v = ingest(spark, "VAMANA", str(tmp_path / f"v{m}"), input_vectors=x, external_ids=ids, distance_metric=m, l_build=30, r_max_degree=12, shards=2)
        d3, i3 = v.query_matrix(q, 5, l_search=400)
        assert (i == i3).all() and np.allclose(d, d3, atol=1e-5)
        ivf.update(5000, q[0], None)
        assert ivf.query_matrix(q, 1)[1][0, 0] == 5000 and abs(ivf.query_matrix(q, 1)[0][0, 0]) < 1e-5
    d, i = flat[Metric.INNER_PRODUCT].query_matrix(q, 5)
    assert (i == 1000 + np.argsort(-(q.astype(float) @ x.T.astype(float)), axis=1)[:, :5]).all()
    even = spark.range(1000, 1400, 2).toDF("external_id")
    d, i = flat[Metric.L2].query_matrix(q, 5, ids=even)
    want = np.argsort(((q[:, None].astype(float) - x[::2]) ** 2).sum(2), axis=1)[:, :5] * 2 + 1000
    assert (i == want).all()
    p = ingest(spark, "IVF_PQ", str(tmp_path / "pq"), input_vectors=x, external_ids=ids, num_subspaces=4, distance_metric="L2")
    d, i = flat[Metric.L2].query_matrix(q, 5)
    d2, i2 = p.query_matrix(q, 5, k_factor=50)
    assert (i == i2).all() and np.allclose(d, d2, atol=1e-5)
    assert len(np.intersect1d(p.query_matrix(q, 5)[1], i)) > 25
    again = ingest(spark, "IVF_FLAT", str(tmp_path / "c"), input_vectors=x, copy_centroids_uri=ivf.store.path("centroids", ivf.version), partitions=20)
    assert again.meta["partition_history"] == [20]
    plan = again.query(q[:1], 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part_id", plan)
    ivf.consolidate_updates()
    assert ivf.size == 401 and ivf.query_matrix(q, 1)[1][0, 0] == 5000
    with pytest.raises(ValueError):
        ivf.consolidate_updates(partitions=3)


def test_repeated_and_null_rows(spark, tmp_path):
    rows = [(1, [1.0, 1.0]), (1, [0.0, 1.0]), (2, [2.0, 2.0]), (2, [2.0, 2.0]), (None, [3.0, 3.0]), (4, None)]
    index = ingest(spark, "FLAT", str(tmp_path / "i"), input_vectors=spark.createDataFrame(rows, "external_id long, vector array<float>"))
    assert sorted((r.external_id, r.vector) for r in index.vectors().collect()) == [(1, [0.0, 1.0]), (2, [2.0, 2.0])] and index.size == 2


def test_update_log_is_compacted(spark, tmp_path):
    index = create(spark, str(tmp_path / "e"), "FLAT", 2)
    for i in range(12):
        index.update(i % 5, [float(i), 0.0], 100 + i)
    want = sorted(map(tuple, index.vectors().selectExpr("external_id", "vector[0]").collect()))
    index.vacuum()
    assert len([n for n in index.store.files.names(f"{index.uri}/updates") if n.endswith(".parquet")]) < 12
    index.refresh()
    assert sorted(map(tuple, index.vectors().selectExpr("external_id", "vector[0]").collect())) == want == [(i, v) for i, v in ((0, 10.0), (1, 11.0), (2, 7.0), (3, 8.0), (4, 9.0))]


@pytest.mark.parametrize("step", ["append_updates", "save", "delete"])
def test_an_interrupted_rewrite_loses_no_update(spark, tmp_path, monkeypatch, step):
    uri = str(tmp_path / "i")
    index = ingest(spark, "FLAT", uri, input_vectors=np.zeros((3, 2), np.float32), index_timestamp=10)
    for i in range(4):
        index.update(10 + i, [1.0, i], 20 + i)
    owner = index.store.files if step == "delete" else index.store

    def killed(*args, **kw):
        raise KeyboardInterrupt

    monkeypatch.setattr(owner, step, killed)
    with pytest.raises(KeyboardInterrupt):
        index.store.rewrite_updates(index.store.updates(22))
    monkeypatch.undo()
    left = {r.external_id for r in open_index(spark, uri).store.updates().collect()}
    assert left == ({12, 13} if step == "delete" else {10, 11, 12, 13})
    index = open_index(spark, uri)
    index.update(20, [5.0, 5.0], 40)
    index.vacuum()
    assert {r.external_id for r in index.store.updates().collect()} == left | {20}
    assert sum(n.startswith("updates") for n in index.store.files.names(uri)) == 1


def test_vamana_with_many_updates_walks_no_wider(spark, tmp_path):
    from vexel.operators import graph

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    index = ingest(spark, "VAMANA", str(tmp_path / "i"), input_vectors=x, index_timestamp=10, l_build=60, r_max_degree=24)
    moved = np.arange(0, 1500, 2)
    fresh = rng.normal(size=(len(moved), 8)).astype(np.float32)
    index.update_batch(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(moved, fresh)], "external_id long, vector array<float>"), 20)
    now = x.copy()
    now[moved] = fresh
    q = rng.normal(size=(30, 8)).astype(np.float32)
    _, ids = index.query_matrix(q, 10)
    hits = sum(len(set(ids[i].tolist()) & set(np.argsort(((now - v) ** 2).sum(1))[:10].tolist())) for i, v in enumerate(q))
    assert hits >= 0.97 * 300
    g = index.store.read("graph", index.version)
    near = {int(i) for i in np.argsort(((x - q[0]) ** 2).sum(1))[:300]}
    gone = spark.createDataFrame([(i,) for i in near], "external_id long")
    got = graph.vamana_query(g, spark.createDataFrame([(0, q[0].tolist())], "query_id long, vector array<float>"), 10, 20, gone=gone)
    want = [i for i in np.argsort(((x - q[0]) ** 2).sum(1)).tolist() if i not in near][:10]
    assert {r.external_id for r in got.collect()} == set(want)
