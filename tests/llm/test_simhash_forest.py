import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vexel.llm import simhash_forest as sf
from vexel.llm.common import components
from vexel.llm.common import table

SF = "/root/testdata/sf0.01"


def brute_groups(rows):
    """Least doc_id of each group of documents joined by pairs within the radius."""
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    sig, n = sf.signatures_of(pa.array([t for _, t in rows], pa.string()))
    ids = np.array([i for i, _ in rows])
    root = {i: i for i in ids.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for a in range(len(rows)):
        d = np.bitwise_count(sig ^ sig[a]).sum(1)
        for b in np.flatnonzero(d <= sf.RADIUS):
            if a < b and n[a] and n[b]:
                pairs.append((int(ids[a]), int(ids[b])))
                x, y = find(ids[a].item()), find(ids[b].item())
                root[max(x, y)] = min(x, y)
    return pairs, {i: find(i) for i in root if find(i) != i}


def test_simhash_is_the_sign_of_the_summed_bits():
    from vexel.llm import textvec as tv

    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    row = np.sort(rng.integers(0, 7, 500))
    got = tv.simhash(h, row, 7, 1)[:, 0]
    for r in range(7):
        want = 0
        for bit in range(64):
            s = sum(1 if (int(x) >> bit) & 1 else -1 for x in h[row == r])
            want |= (s > 0) << bit
        assert int(got[r]) == want


def test_signature_does_not_depend_on_the_batch():
    texts = [f"w{i} v{i % 3} common words here and some more {i * 7}" for i in range(300)] + ["long " * 200_000, "", "one"]
    whole, _ = sf.signatures_of(pa.array(texts))
    for k in (0, 5, 299, 300, 302):
        assert (sf.signatures_of(pa.array([texts[k]]))[0][0] == whole[k]).all()


def links_of(pairs, rows):
    """Number of different signatures within the radius of each document's."""
    sig = {i: bytes(x) for (i, _), x in zip(rows, sf.signatures_of(pa.array([t for _, t in rows], pa.string()))[0])}
    out = {i: set() for i in sig}
    for a, b in pairs:
        if sig[a] != sig[b]:
            out[a].add(sig[b])
            out[b].add(sig[a])
    return {i: len(x) for i, x in out.items()}


def test_recall_against_brute_force(spark):
    """With the shipped recall, radius and tries; small leaves and blocks make the forest as deep as it is on large tables."""
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pairs, want = brute_groups(rows)
    links = links_of(pairs, rows)
    for leaf, block in ((8, 32), (2, 4)):
        got = {r.doc_id: (r.kept_id, r.n_links) for r in sf.near_duplicates(docs, leaf=leaf, block=block).collect()}
        root = {i: k for i, (k, _) in got.items()}
        joined = sum(root.get(a, a) == root.get(b, b) for a, b in pairs)
        assert len(pairs) > 50 and joined >= sf.TARGET_RECALL * len(pairs)
        assert set(got) <= set(want) and all(n <= links[i] for i, (_, n) in got.items())
        assert sum(n for _, n in got.values()) >= sf.TARGET_RECALL * sum(links[i] for i in got)
    for block in (1 << 20, 100):
        exact = {r.doc_id: (r.kept_id, r.n_links) for r in sf.near_duplicates(docs, leaf=1 << 20, block=block, max_tries=1).collect()}
        assert exact == {i: (k, links[i]) for i, k in want.items()}  # one node holds all: nothing is approximate


def test_query_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pairs, want = brute_groups(rows)
    links = links_of(pairs, rows)
    assert {(r.doc_id, r.kept_id, r.n_links) for r in sf.op4_simhash_forest(spark, SF).collect()} == {(i, k, links[i]) for i, k in want.items()}


def _sigs(spark, sig):
    rows = [(i, *map(int, s.view(np.int64))) for i, s in enumerate(sig)]
    return spark.createDataFrame(rows, "node long, s0 long, s1 long, s2 long, s3 long")


def test_dense_regions_have_longer_prefixes_and_more_tries(spark):
    """Half of the signatures lie close together: no node of theirs is compared whole while a longer prefix can be paid for, and pairs at the radius are found."""
    rng = np.random.default_rng(3)

    def flip(x, n):
        y = x.copy()
        for bit in rng.permutation(sf.BITS)[:n]:
            y[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        return y

    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    dense = [flip(centre, 60) for _ in range(3000)]
    spread = list(rng.integers(0, 1 << 63, (3000, 4), dtype=np.uint64))
    planted = [(x, flip(x, sf.RADIUS)) for x in [*dense[:150], *spread[:150]]]
    sig = np.array([*dense, *spread, *(y for _, y in planted)])
    d = _sigs(spark, sig).repartition(4)
    forest = sf.grow(d, len(sig), leaf=64, block=128)
    usual, most = sf.plan(len(sig), leaf=64)
    assert usual < forest.depth <= most and len(forest.picks) > sf.tries_for(usual)
    names = forest.names(sig, len(forest.picks))
    depth = names & 31
    assert depth[:3000].mean() > depth[3000:6000].mean() + 1
    if forest.depth < most:
        assert forest.blocks is None
    got = sf.near_edges(d, len(sig), leaf=64, block=128).collect()
    root = list(range(len(sig)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        if r.a != r.b:
            assert np.bitwise_count(sig[r.a] ^ sig[r.b]).sum() <= 6 * sf.RADIUS
            x, y = find(r.a), find(r.b)
            root[max(x, y)] = min(x, y)
    links = {r.a: r.n for r in got if r.a == r.b}
    true = np.array([(np.bitwise_count(sig ^ x).sum(1) <= sf.RADIUS).sum() - 1 for x in sig])
    found = np.array([links.get(i, 0) for i in range(len(sig))])
    assert (found <= true).all() and found.sum() >= 0.93 * true.sum()
    alone = [k for k in range(150, 300)]
    assert sum(find(3000 + k - 150) == find(6000 + k) for k in alone) >= 0.9 * len(alone)


def test_plan_climbs_until_the_recall_is_reached():
    for n in (0, 1, 1000, 10**6, 10**9):
        usual, most = sf.plan(n)
        assert usual <= most and sf.tries_for(most) <= sf.MAX_TRIES < sf.tries_for(most + 1)
        for d in (usual, most):
            assert 1 - (1 - sf.hit_rates(d)[-1]) ** sf.tries_for(d) >= sf.TARGET_RECALL
    rng = np.random.default_rng(0)
    y = np.arange(sf.BITS) < sf.RADIUS
    share = np.mean([not y[rng.permutation(sf.BITS)[:6]].any() for _ in range(20_000)])
    assert abs(share - sf.hit_rates(6)[-1]) < 0.015


def test_tries_are_cut_by_density():
    rng = np.random.default_rng(0)
    counts = (rng.pareto(0.7, 64) * 5).astype(int)
    depth = sf.cut_depths(counts, 40)
    for key, d in enumerate(depth):
        node = lambda k: counts[(key >> (6 - k)) << (6 - k) : ((key >> (6 - k)) + 1) << (6 - k)].sum()
        assert d == next((k for k in range(6) if node(k) <= 40), 6)
    deep = sf.cut_depths(counts, 40, 3, 200)
    for key, d in enumerate(deep):
        node = lambda k: counts[(key >> (6 - k)) << (6 - k) : ((key >> (6 - k)) + 1) << (6 - k)].sum()
        assert d == next((k for k in range(6) if node(k) <= (40 if k < 3 else 200)), 6)
    assert sf.cut_depths(np.array([5]), 1).tolist() == [0]


def test_nulls_empty_repeats_and_other_columns(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(1, text, "a"), (2, text, "b"), (3, None, "c"), (4, "", "d"), (5, "", "e"), (None, text, "f"), (6, text.replace("word7 ", "other "), "g"), (7, "quite another thing", "h"), (8, "?!", "i"), (8, "?!", "i"), (9, "twice given row", "j"), (9, "twice given row", "j"), (9, "the same id with another text", "k"), (10, "long " * 200_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s0 string").withColumns({"node": F.lit("x"), "id": F.lit(1), "_vx_id": F.lit(2), "a.b": F.lit(3), "text_hash": F.lit(4)})
    got = {(r.doc_id, r.kept_id, r.n_links) for r in sf.near_duplicates(docs).collect()}
    assert got == {(2, 1, 1), (6, 1, 1)}
    left = sf.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4, 5, 7, 8, 9, 9, 10]
    assert sf.near_duplicates(docs.limit(0)).count() == 0 and sf.drop_near_duplicates(docs.limit(0)).count() == 0
    text_ids = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(r.doc_id, r.kept_id) for r in sf.near_duplicates(text_ids).collect()} == {("d2", "d1"), ("d6", "d1")}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (5, 5), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100}
