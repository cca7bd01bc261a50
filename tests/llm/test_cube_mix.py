import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import cube_mix as cm
from vexel.llm.common import table

SF = "/root/testdata/sf0.01"


def test_flight_keeps_both_totals_and_decides_all_but_two():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 500):
        for tokens in (rng.integers(1, 1000, n), np.full(n, 7), np.zeros(n, int)):
            p = rng.random(n)
            out = cm.flight(p, tokens, rng)
            assert ((out > 0) & (out < 1)).sum() <= 2
            assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * tokens).sum() - (p * tokens).sum()) < 1e-4
            end = cm.landing(out, tokens, rng)
            assert set(end.tolist()) <= {0.0, 1.0} and abs(end.sum() - p.sum()) < 1


def test_inclusion_probabilities_are_kept():
    p, t = np.array([0.1, 0.5, 0.9, 0.3, 0.7, 0.5, 0.25]), np.array([5, 1, 9, 30, 2, 2, 100])
    rng = np.random.default_rng(0)
    got = np.mean([cm.landing(cm.flight(p, t, rng), t, rng) for _ in range(20_000)], 0)
    assert np.abs(got - p).max() < 0.015


def test_rates():
    assert cm.rates({"a": 100, "b": 100}, 0.5) == {"a": 0.5, "b": 0.5}
    r = cm.rates({"a": 1000, "b": 10, "c": 0}, 0.5, {"a": 1, "b": 1, "c": 1})
    assert r["b"] == 1.0 and r["c"] == 0.0 and abs(1000 * r["a"] + 10 - 505) < 1e-9
    assert cm.rates({"a": 5, "b": 5}, 2.0) == {"a": 1.0, "b": 1.0}
    assert cm.rates({}, 0.5) == {} and cm.rates({"a": 5, "b": 5}, 1.0, {"a": 1}) == {"a": 1.0, "b": 0.0}


def test_totals_of_the_query(spark):
    docs = table(spark, SF, "documents")
    words = {r.doc_id: (r.source, len(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", r.text))) for r in docs.collect()}
    got = cm.op2_cube_mix(spark, SF).collect()
    assert len({r.doc_id for r in got}) == len(got) and all(words[r.doc_id] == (r.source, r.n_tokens) for r in got)
    total = Counter()
    for s, n in words.values():
        total[s] += n
    rate = cm.rates(total)
    most = max(n for _, n in words.values())
    for s in total:
        mine = [r for r in got if r.source == s]
        assert abs(len(mine) - rate[s] * sum(x == s for x, _ in words.values())) <= 2
        assert abs(sum(r.n_tokens for r in mine) - rate[s] * total[s]) <= 2 * most
        assert all(abs(r.pi - rate[s]) < 1e-12 for r in mine)
    assert abs(len(got) - sum(rate[s] for s, _ in words.values())) < 1.001
    assert sorted(r.doc_id for r in cm.op2_cube_mix(spark, SF).collect()) == sorted(r.doc_id for r in got)


def test_chunks_balance_like_one(spark):
    d = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('w ', cast(1 + id * 7919 % 101 AS int)) AS text")
    got = cm.balanced_sample(d, budget=0.5, weights={"s0": 1, "s1": 1, "s2": 1}, chunk_rows=100).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.first("pi").alias("pi")).collect()
    all_ = {r.source: r.t for r in d.selectExpr("source", "1 + doc_id * 7919 % 101 AS t").groupBy("source").agg(F.sum("t").alias("t")).collect()}
    for r in got:
        assert abs(r.n - 1000 * r.pi) <= 2 and abs(r.t - r.pi * all_[r.source]) <= 202


def test_nulls_repeats_empty_and_other_columns(spark):
    rows = [(None, "a", "x y"), (None, "a", "x y z"), (1, None, "p q"), (2, "b", None), (3, "b", ""), (4, "b", "one two"), (4, "b", "one two"), (5, "c", "")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("p", F.lit("mine")).withColumn("n_tokens", F.lit(1.5))
    got = {(r.doc_id, r.source): r.n_tokens for r in cm.balanced_sample(d, budget=1.0).collect()}
    assert got == {(None, "a"): 5, (1, None): 2, (2, "b"): 0, (3, "b"): 0, (4, "b"): 4}
    d = d.withColumns({"_vx_id": F.lit(1), "_vx_source": F.lit(1), "a.b": F.lit(2)})
    kept = cm.keep_sample(d, budget=1.0)
    assert kept.columns == d.columns and kept.count() == 7
    assert cm.keep_sample(d.limit(0)).count() == 0 and cm.balanced_sample(d.limit(0)).count() == 0


def test_string_ids_and_a_very_long_text(spark):
    rows = [(f"d{i}", f"s{i % 2}", "w " * (1 + i % 7)) for i in range(200)] + [("long", "s0", "word " * 400_000)]
    d = spark.createDataFrame(rows, "doc_id string, source string, text string")
    got = cm.balanced_sample(d, budget=0.5, weights={"s0": 1, "s1": 1}).collect()
    assert len({r.doc_id for r in got}) == len(got) > 50 and all(r.n_tokens == 400_000 for r in got if r.doc_id == "long")
    assert sorted(r.doc_id for r in cm.keep_sample(d, budget=0.5).collect()) == sorted(r.doc_id for r in cm.keep_sample(d.repartition(7), budget=0.5).collect())
