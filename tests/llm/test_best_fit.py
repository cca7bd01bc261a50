import re
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_simhash_forest import brute_groups
from vexel.llm import best_fit as bf
from vexel.llm.common import table

SF = "/root/testdata/sf0.01"


def slow_pack(sizes, sources, clusters, capacity, most):
    """Looks at every bin for every item."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        best = None
        for i, b in enumerate(bins):
            room = capacity - sum(x for x, _, _ in b)
            if room >= n and sum(y == s for _, y, _ in b) < most and all(z != c for _, _, z in b) and (best is None or room < best[0]):
                best = (room, i)
        if best is None:
            bins.append([])
            best = (0, len(bins) - 1)
        bins[best[1]].append((n, s, c))
        out.append(best[1])
    return out


def test_pack_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 30, 200):
        for most in (1, 2, 5):
            sizes = sorted(rng.integers(1, 101, n).tolist(), reverse=True)
            sources, clusters = rng.integers(0, 5, n).tolist(), rng.integers(0, max(1, n // 2), n).tolist()
            assert bf.pack(sizes, sources, clusters, 100, most) == slow_pack(sizes, sources, clusters, 100, most)


def test_hot_sources_and_clusters_take_no_walk_over_all_bins():
    rng = np.random.default_rng(2)
    cases = {
        "one cluster": (sorted(rng.integers(1, 3000, 16_000).tolist(), reverse=True), rng.integers(0, 30, 16_000).tolist(), [0] * 16_000),
        "one source": ([4] * 20_000, [0] * 20_000, list(range(20_000))),
        "two clusters in turn": (sorted(rng.integers(1, 3000, 8_000).tolist(), reverse=True), rng.integers(0, 30, 8_000).tolist(), rng.integers(0, 2, 8_000).tolist()),
    }
    for name, (sizes, sources, clusters) in cases.items():
        t = time.process_time()
        bins = bf.pack(sizes, sources, clusters)
        assert time.process_time() - t < 3, name
        if name == "one cluster":
            assert len(set(bins)) == len(sizes)
        elif name == "one source":
            assert max(Counter(bins).values()) == bf.MAX_PER_SOURCE and len(set(bins)) == 5000
        else:
            assert max(Counter(zip(bins, clusters)).values()) == 1


def test_long_walks_find_what_a_look_at_every_bin_finds(monkeypatch):
    monkeypatch.setattr(bf, "WALK", 2)
    rng = np.random.default_rng(7)
    for most, groups in ((1, 3), (2, 40), (3, 5)):
        sizes = sorted(rng.integers(1, 60, 300).tolist(), reverse=True)
        sources, clusters = rng.integers(0, 4, 300).tolist(), rng.integers(0, groups, 300).tolist()
        assert bf.pack(sizes, sources, clusters, 100, most) == slow_pack(sizes, sources, clusters, 100, most)


def check(rows, words, capacity, most, cluster):
    per, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert set(per) == set(words)
    for i, pieces in per.items():
        pieces = sorted(pieces, key=lambda r: r.piece)
        assert sum(r.n_tokens for r in pieces) == words[i]
        assert [r.first_token for r in pieces] == [capacity * k for k in range(len(pieces))]
        assert all((r.bin_id is None) == (words[i] == 0) for r in pieces)
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= capacity
        assert max(Counter(r.source for r in b).values()) <= most
        assert max(Counter(cluster[r.doc_id] for r in b).values()) == 1
    return len(bins)


def test_words_and_clusters_of_items(spark):
    docs = table(spark, SF, "documents").collect()
    words = {r.doc_id: len(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", r.text)) for r in docs}
    fold = lambda t: "".join(c.lower() if c < "\x80" else c for c in t)
    cluster = {r.doc_id: tuple(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", fold(r.text))) for r in docs}
    groups = {}
    for r in bf.items_of(table(spark, SF, "documents").select("doc_id", "source", "text")).collect():
        assert r.tokens == words[r.doc_id]
        groups.setdefault(r.cluster, set()).add(cluster[r.doc_id])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(cluster.values())) < len(docs)
    rows = bf.pack_documents(table(spark, SF, "documents"), capacity=64, max_per_source=1, shard_rows=200).collect()
    check(rows, words, 64, 1, cluster)


def test_query_against_brute_force(spark):
    """All rows of the query, from near duplicates by all pairs and a look at every bin for every item."""
    docs = table(spark, SF, "documents").collect()
    _, root = brute_groups([(r.doc_id, r.text) for r in docs])
    kept = spark.createDataFrame([(r.doc_id, root.get(r.doc_id, r.doc_id)) for r in docs], "doc_id long, kept long").selectExpr("doc_id", "xxhash64(kept) AS cluster")
    cluster = {r.doc_id: r.cluster for r in kept.collect()}
    words = {r.doc_id: len(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", r.text)) for r in docs}
    todo = []
    for r in sorted(docs, key=lambda r: (-words[r.doc_id], r.doc_id)):
        n = words[r.doc_id]
        todo += [(min(bf.CAPACITY, n - k * bf.CAPACITY), k < n // bf.CAPACITY, r, k) for k in range(-(-n // bf.CAPACITY))]
    todo.sort(key=lambda x: (-x[0], not x[1]))
    bins = slow_pack([n for n, *_ in todo], [r.source for _, _, r, _ in todo], [cluster[r.doc_id] for _, _, r, _ in todo], bf.CAPACITY, bf.MAX_PER_SOURCE)
    want = {(b, r.doc_id, r.source, k, k * bf.CAPACITY, n) for b, (n, _, r, k) in zip(bins, todo)} | {(None, r.doc_id, r.source, 0, 0, 0) for r in docs if not words[r.doc_id]}
    rows = bf.op6_best_fit(spark, SF).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) and root
    assert check(rows, words, bf.CAPACITY, bf.MAX_PER_SOURCE, cluster) * bf.CAPACITY * 0.8 < sum(words.values())


def test_repeated_rows_are_spread_over_bounded_shards(spark):
    d = spark.range(60_000).selectExpr("cast(null AS long) AS doc_id", "'hot' AS source", "'the same four words' AS text").unionByName(spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 9) AS source", "concat('own words ', id) AS text"))
    items = bf.cut(bf.items_of(d).withColumn("row", F.monotonically_increasing_id()), "items")
    sizes = [r["count"] for r in bf._sharded(items, 5000).groupBy("shard").count().collect()]
    assert sum(sizes) == 63_000 and max(sizes) < 6000
    got = bf.pack_documents(d, shard_rows=5000)
    assert got.count() == 63_000 and got.where("doc_id IS NULL").select("bin_id").distinct().count() == 60_000


def test_nulls_repeats_empty_and_own_clusters(spark):
    rows = [(None, "a", "x y"), (None, "a", "x y"), (1, None, "p q"), (2, "b", None), (3, "b", ""), (4, "c", "one two"), (4, "c", "one two"), (5, "d", "w " * 50_000), (1 << 60, "e", "z")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("bin_id", F.lit("x")).withColumn("group", F.lit(1).cast("int"))
    got = bf.pack_documents(d).collect()
    bins = Counter((r.doc_id, r.bin_id) for r in got if r.doc_id in (None, 4))
    assert len(bins) == 4 and sum(r.doc_id == 5 for r in got) == 13 and sum(r.doc_id == 1 << 60 for r in got) == 1
    assert [r.n_tokens for r in got if r.bin_id is None] == [0, 0]
    one = bf.pack_documents(d.where("doc_id <> 5"), cluster="group").where("bin_id is not null").collect()
    assert len({r.bin_id for r in one}) == len(one) == 4
    none = bf.pack_documents(d.where("doc_id <> 5").withColumn("group", F.lit(None).cast("int")), cluster="group").where("bin_id is not null").collect()
    assert len({r.bin_id for r in none}) == 2  # only the repeated rows are apart
    assert bf.pack_documents(d.limit(0)).count() == 0
