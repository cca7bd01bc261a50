"""The approximate queries against brute force, on a table that is large enough to lose neighbours."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from vexel.queries import QUERIES, K

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def distances():
    x = np.array(pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id")["embedding"].to_pylist(), np.float64)
    return ((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T).round(12)


def recall(pairs, d):
    truth = {(i, int(j)) for i, r in enumerate(np.argsort(d, 1, kind="stable")[:, :K]) for j in r}
    return len(set(pairs) & truth) / len(truth)


def test_nn_descent(spark, distances):
    d = distances.copy()
    np.fill_diagonal(d, np.inf)
    got = [(r.src, r.dst) for r in QUERIES["nn_descent"](spark, SF).collect()]
    found = recall(got, d)
    print("nn_descent", found)
    assert len(got) == len(set(got)) == K * len(d) and found >= 0.9


def test_bfs_reaches_all_that_can_be_reached(spark, distances):
    d = distances.copy()
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, :5]
    want, level = {0: 0}, [0]
    while level:
        level = sorted({int(j) for i in level for j in near[i]} - set(want))
        want |= dict.fromkeys(level, max(want.values()) + 1)
    got = {r.node: r.level for r in QUERIES["bfs_levels"](spark, SF).collect()}
    assert got == want and max(got.values()) > 6


@pytest.mark.parametrize("name", ["ivf_query_nprobe12", "ivf_query_join", "ivf_pq_rerank", "pq_adc_topk", "pq_symmetric_topk"])
def test_searches_with_fixed_centroids(spark, distances, name):
    got = [(r.query_id, r.external_id) for r in QUERIES[name](spark, SF).collect()]
    found = recall(got, distances)
    print(name, found)
    assert len(got) == K * len(distances) and found >= 0.9


@pytest.mark.parametrize("name,least", [("ivf_trained", 0.9), ("ivf_pq_trained", 0.9), ("vamana_query_L100", 0.95)])
def test_trained_searches(spark, distances, name, least):
    got = [(r.query_id, r.external_id) for r in QUERIES[name](spark, SF).collect()]
    found = recall(got, distances)
    print(name, found)
    assert len(got) == K * len(distances) and found >= least
