import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vexel.llm import scaled_sketch as ss
from vexel.llm.common import table

SF = "/root/testdata/sf0.001"


def shingle_set(text, k=ss.SHINGLE):
    w = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)
    w = ["".join(c.lower() if c < "\x80" else c for c in x) for x in w]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_all_hashes_are_the_shingles():
    texts = ["", "one", "one two THREE four", "a b c d e", "a b c d e f g " * 50, "été là, où ça? " * 9, "x" * 10_000 + " y"]
    v, off = ss.sketch_arrays(pa.array(texts), fraction=0.5)
    v1, off1 = ss.sketch_arrays(pa.array(texts * 3), fraction=0.5)
    assert (v1[: len(v)] == v).all() and (off1[: len(off)] == off).all()
    big, o = ss.sketch_arrays(pa.array([" ".join(str(i * 7919 % 10007) for i in range(40_000))]), fraction=0.25)
    n = len(shingle_set(" ".join(str(i * 7919 % 10007) for i in range(40_000))))
    assert abs(o[-1] / 0.25 / n - 1) < 0.1 and n > 9000


def test_containment_against_brute_force(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    d = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    b = {r.item_id: shingle_set(r.text) for r in bench.collect()}
    got = ss.containment(ss.sketches(bench, "item_id", fraction=0.5), ss.sketches(docs, fraction=0.5), "item_id", "doc_id", 0.0)
    got = {(r.item_id, r.doc_id): r.containment for r in got.collect()}
    want = {(i, j): len(x & y) / len(x) for i, x in b.items() for j, y in d.items() if x & y}
    high = {p for p, c in want.items() if c > 0.9}
    assert high and high <= set(got)
    assert all(abs(got.get(p, 0) - c) < 0.45 for p, c in want.items())
    assert all(p in want for p in got)


def test_union_is_the_sketch_of_both(spark):
    rows = [(1, "a", " ".join(map(str, range(600)))), (2, "a", " ".join(map(str, range(400, 900)))), (3, "b", None), (4, None, "x y z")]
    d = spark.createDataFrame(rows, "doc_id long, sketch string, text string")
    s = ss.sketches(d, fraction=0.5)
    m = {r.k: r.sketch for r in ss.merged(s.join(d.select("doc_id", F.col("sketch").alias("k")), "doc_id"), "k").collect()}
    whole = ss.sketches(spark.createDataFrame([(0, " ".join(map(str, range(900))))], "doc_id long, text string"), fraction=0.5).first().sketch
    assert m["a"] == whole and "b" not in m


def test_query_nulls_and_empty(spark):
    got = ss.op7_scaled_sketch(spark, SF)
    assert got.count() == table(spark, SF, "documents").count() and got.where("contains is not null").count() > 0
    d = spark.createDataFrame([(None, None), (1, ""), (2, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = [(r.doc_id, len(r.sketch)) for r in ss.sketches(d, fraction=0.5).collect()]
    assert got[0] == (None, 0) and got[1] == (1, 0) and got[2] == got[3]
    assert ss.sketches(d.limit(0)).count() == 0
    long = " ".join(map(str, range(300_000)))
    d = spark.createDataFrame([(1, long, 0), (2, None, 0), (2, None, 0)], "`a.b` long, text string, contains int")
    items = spark.createDataFrame([(7, long[-200:]), (8, long[-200:]), (None, long), (9, "")], "`c.d` long, text string")
    for most in (ss.INDEX_SHINGLES, 0):
        got = ss.contained(d, items, "a.b", "c.d", most=most)
        assert got.columns == ["a.b", "sketch", "contains"]
        got = sorted(((r[0], len(r.sketch) > 100_000, [tuple(x) for x in r.contains or []]) for r in got.collect()))
        assert [g[:2] for g in got] == [(1, True), (2, False), (2, False)] and [x[0] for x in got[0][2]] == [7, 8]
        assert ss.contained(d.limit(0), items, "a.b", "c.d", most=most).count() == 0


def test_query_finds_every_verbatim_item(spark):
    """At the production fraction, against brute force over all shingles; by look-up and by join."""
    sf = "/root/testdata/sf0.1"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    d = [(r.doc_id, r.text) for r in docs.collect()]
    b = {r.item_id: r.text for r in bench.collect()}
    got = {(c.item_id, r.doc_id): c.containment for r in ss.op7_scaled_sketch(spark, sf).where("contains is not null").collect() for c in r.contains}
    verbatim = {(i, j) for j, t in d for i, x in b.items() if x in t and re.search(rf"(?<!\w){re.escape(x)}(?!\w)", t)}
    assert len(verbatim) > 100 and verbatim <= set(got) and all(got[p] == 1 for p in verbatim)
    items = {i: shingle_set(x) for i, x in b.items()}
    where = {}
    for i, x in items.items():
        for s in x:
            where.setdefault(s, []).append(i)
    want = {}
    for j, t in d:
        n = {}
        for s in shingle_set(t):
            for i in where.get(s, ()):
                n[i] = n.get(i, 0) + 1
        want |= {(i, j): k / len(items[i]) for i, k in n.items() if k >= ss.MIN_CONTAINMENT * len(items[i])}
    assert got == want
    few = docs.where("doc_id < 500")
    one, two = (sorted((r.doc_id, r.sketch, r.contains or []) for r in ss.contained(few, bench, most=m).collect()) for m in (ss.INDEX_SHINGLES, 0))
    assert one == two and any(c for *_, c in one)
