import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import bloom_cascade as bc
from vexel.llm.common import table


@pytest.mark.parametrize("listed,other", [(0, 0), (0, 50), (50, 0), (1, 1), (300, 5000), (5000, 300)])
def test_exact_over_the_universe(listed, other):
    rng = np.random.default_rng(listed + other)
    h1, h2 = rng.integers(0, 1 << 63, (2, listed + other), dtype=np.uint64)
    on = np.arange(listed + other) < listed
    levels = bc.cascade_levels(h1, h2, on)
    assert (bc.member(levels, h1, h2) == on).all()
    assert all((f >= 0).all() for *_, f in levels)


def test_both_ways_of_looking_up(spark):
    d = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumns({"shard": F.lit("x"), "_vx_listed": F.lit(1), "a.b": F.lit(2), "row": F.lit(3)})
    listed = d.where("id % 7 = 0").select("key")
    cascade, shards = bc.build_cascade(d, listed, "key", shard_keys=700)
    assert shards == 5
    d = d.unionByName(d.limit(1).withColumn("key", F.lit(None).cast("string"))).unionByName(d.where("id = 7").crossJoin(spark.range(500).select()))
    for size in (1 << 30, 0):
        got = bc.with_membership(d, F.array("key", F.lit(None).cast("string")), cascade, shards, broadcast_bytes=size, shard_rows=200)
        assert got.columns == [*d.columns, "_vx_listed_"] and got.count() == 3501
        assert got.where("_vx_listed_ <> (key is not null and id % 7 = 0)").count() == 0


def test_url_key(spark):
    want = {
        "https://WWW.Spam-Farm.example.org/En/1/?utm_source=x": "spam-farm.example.org/En/1",
        "http://spam-farm.example.org/En/1#top": "spam-farm.example.org/En/1",
        "spam-farm.example.org/En/1": "spam-farm.example.org/En/1",
        "spam-farm.example.org:80": "spam-farm.example.org",
        "https://user@spam-farm.example.org/": "spam-farm.example.org",
        "http://user:pw@m.spam-farm.example.org:443/a": "spam-farm.example.org/a",
        "http://spam-farm.example.org./a": "spam-farm.example.org/a",
        "//a.org:8080/b?x=http://c.d/@e": "a.org:8080/b?x=http://c.d/@e",
        "http://a.org/?utm_source=1&utm_medium=2": "a.org",
        "http://a.org/p?id=1&utm_source=2#x?y": "a.org/p?id=1",
        "http://a.org/?page=2&ref=x": "a.org?page=2",
        "http://a.org?Ref=x&reference=1": "a.org?reference=1",
        "http://m.a.org": "a.org",
        "http://m.org": "m.org",
        "http://www.org/x": "www.org/x",
        "": "",
        None: None,
    }
    d = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    assert {r.url: r.k for r in d.select("url", bc.url_key(F.col("url")).alias("k")).collect()} == want
    c = duckdb.connect()
    c.register("pages", d.toPandas())
    assert {u: k for _, u, k, _ in c.execute(bc.OP9_SQL).fetchall()} == want


def test_lists_of_urls_domains_and_names(spark):
    urls = ["http://a.bad.org/x", "http://bad.org:8080", "http://notbad.org", "http://ok.org/bad/page/?utm_id=1", "http://ok.org/bad/page2", "http://x.casino-win.co.uk", "http://casino-winner.com", "http://casino-win", "http://bad.org.ok.net", None, "", "http://u@BAD.ORG./?ref=1", "http://" + "sub." * 40 + "bad.org/" + "x" * 100_000]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "id int, url string, _vx_key int, `b.c` int")
    entries = spark.createDataFrame([("https://Bad.org/",), ("ok.org/bad/page",), ("casino-win.*",), (None,), ("",), ("bad.org",)], "entry string")
    got = bc.flagged(pages, entries)
    assert got.columns == [*pages.columns, "_vx_key_", "_vx_listed"]
    assert {r.id for r in got.where("_vx_listed").collect()} == {0, 1, 3, 5, 11, 12} and got.count() == len(urls)
    assert bc.flagged(pages, entries.limit(0)).where("_vx_listed").count() == 0 and bc.flagged(pages.limit(0), entries).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = bc.op9_bloom_cascade(spark, sf)
    pages = table(spark, sf, "pages").collect()
    n = sum(any(f"{e[:-1]}" in r.url for e in bc.BLOCKLIST) for r in pages)
    assert got.where("listed").count() == n > 10 and got.count() == len(pages)
    own = spark.createDataFrame([(pages[0].url,)], "entry string")
    assert bc.op9_bloom_cascade(spark, sf, own).where("listed").count() >= 1


def test_empty(spark):
    d = spark.createDataFrame([], "key string")
    cascade, shards = bc.build_cascade(d, d, "key")
    for size in (1 << 30, -1):
        assert bc.with_membership(d, F.array("key"), cascade, shards, broadcast_bytes=size).count() == 0
