import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_best_fit import check
from tests.llm.test_line_spread import brute
from tests.llm.test_simhash_forest import brute_groups
from vexel.llm import best_fit, cube_mix, line_spread
from vexel.llm import subword_quality as sq
from vexel.llm.common import table

SF = "/root/testdata/sf0.01"


def words(t):
    return len(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t or ""))


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns, name
            after = {r.doc_id: r for r in out.collect()}
        if k == 0:
            model = sq.fit(docs, table(spark, SF, "labels"))
            p = sq.score(pa.array([t for *_, t in before]), model)
            assert set(after) == {i for (i, _, _), x in zip(before, p[:, sq.GOOD]) if x >= sq.THRESHOLD}
            own = table(spark, SF, "labels").collect()
            bad = {r.doc_id for r in own if not r.quality or r.toxic}
            good = {r.doc_id for r in own if r.quality and not r.toxic}
            assert len(bad & set(after)) <= 0.05 * len(bad) and len(good & set(after)) >= 0.99 * len(good) and any(r.toxic and r.quality for r in own)
        elif k == 1:
            want = {i: t for i, t, n in brute(before, line_spread.MIN_SITES) if not n or t.strip()}
            assert {i: r.text for i, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif k == 2:
            _, groups = brute_groups([(i, t) for i, _, t in before])
            assert set(after) == {i for i, *_ in before} - set(groups) and groups
        elif k == 3:
            totals = {}
            for _, s, t in before:
                totals[s] = totals.get(s, 0) + words(t)
            rate = cube_mix.rates(totals)
            assert set(after) <= {i for i, *_ in before}
            assert abs(len(after) - sum(rate[s] for _, s, _ in before)) < 1.001
        else:
            w = {i: words(t) for i, _, t in before}
            check(out.collect(), w, best_fit.CAPACITY, best_fit.MAX_PER_SOURCE, {i: i for i in w})
        docs = out
    assert sorted(map(tuple, cp.run(spark, SF).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, text, "en", "a", len(text), "x"), (2, text, None, "b", len(text), "x"), (2, text, None, "b", len(text), "x"), (None, text, "en", None, None, None), (3, None, "en", "a", 0, "x"), (4, "", "en", "a", 0, "x"), (5, "long " * 60_000, "en", "c", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _vx string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_odd_rows_and_empty_tables(spark, odd):
    docs = table(spark, odd, "documents").withColumnRenamed("_vx", "tokens").withColumns({c: F.lit(1) for c in ("_vx_good", "_vx_removed", "_vx_drop", "_vx_id", "_vx_source", "_vx_row", "a.b", "label", "shard")})
    for name, stage in cp.STAGES:
        out = stage(spark, docs, odd)
        got = out.count()
        assert name == "best-fit packing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), odd).count() == 0
        if name == "near-duplicate removal":
            assert got == 5  # 1, the null id, 3, 4 and 5
    assert cp.run(spark, odd).columns == ["bin_id", "doc_id", "source", "piece", "first_token", "n_tokens"]
