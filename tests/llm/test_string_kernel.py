import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vexel.llm import string_kernel as sk
from vexel.llm.common import table

SF = "/root/testdata/sf0.01"


def bucket(gram: bytes) -> int:
    n = len(gram)
    x = int.from_bytes(gram, "little")
    h = (x + (n * 0x9E3779B1 & 0xFFFFFFFF)) * 2654435761 & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 2246822519 & 0xFFFFFFFF) >> (32 - sk.BITS)


def test_kernel_against_sets():
    texts = ["Hello there", "hello THERE and more", "ab", "a", "", "été " * 100, "x" * 5000]
    sets = []
    for t in texts:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
        sets.append({bucket(b[i : i + n]) for n in sk.NGRAMS for i in range(len(b) - n + 1)})
    x = sk._all_presence(pa.array(texts))
    assert [set(np.flatnonzero(r)) for r in x] == sets
    k = sk.kernel(x, x.astype(np.float32), np.sqrt(x.sum(1)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            want = len(a & b) / max(1, (len(a) * len(b)) ** 0.5)
            assert abs(k[i, j] - want) < 1e-5


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents").where("length(text) > 40")
    train = docs.where("doc_id % 2 = 0")
    model = sk.fit(train, per_language=40)
    got = sk.with_language(docs.where("doc_id % 2 = 1"), model).agg(F.avg((F.col("_vx_lang") == F.col("lang")).cast("int"))).first()[0]
    assert got > 0.97


def test_nulls_empty_and_no_model(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "", "fr"), (3, "the cat and the dog", "en"), (3, "the cat and the dog", "en"), (4, "le chat et le chien", "fr"), (5, "le chat", None), (None, "x" * 300_000, "de")], "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "a.b": F.lit(2), "_VX_LANG": F.lit(3)})
    m = sk.fit(d)
    assert m.languages == ["en", "fr"]
    got = {r.doc_id: r._vx_lang_ for r in sk.with_language(d, m).collect()}
    assert got[1] is None and got[2] is None and got[3] == "en" and got[4] == "fr" and got[5] == "fr" and got[None] is not None
    assert sk.fit(d.limit(0)) is None
    none = sk.with_language(d, None)
    assert none.where("_vx_lang_ is not null").count() == 0 and none.columns == [*d.columns, "_vx_lang_", "_vx_score"]
    assert sk.with_language(d.limit(0), m).count() == 0


def test_query_against_brute_force(spark):
    """All rows of the query: kernels of sets, one pair of texts after another, and a ridge regression per language."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in table(spark, sf, "documents").orderBy(F.xxhash64("doc_id")).collect()}
    grams = {}
    for i, r in docs.items():
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in r.text.encode())
        grams[i] = {bucket(b[k : k + n]) for n in sk.NGRAMS for k in range(len(b) - n + 1)}
    langs = sorted({r.lang for r in docs.values()})
    train = [i for g in langs for i in [i for i, r in docs.items() if r.lang == g][: sk.TRAIN_PER_LANGUAGE]]
    marks = [i for g in langs for i in [i for i in train if docs[i].lang == g][: sk.LANDMARKS_PER_LANGUAGE]]

    def row(i):
        return np.array([len(grams[i] & grams[m]) / max(1, (len(grams[i]) * len(grams[m])) ** 0.5) for m in marks])

    k = np.array([row(i) for i in train])
    val, vec = np.linalg.eigh(np.array([row(i) for i in marks]))
    ok = val > 1e-6 * val.max()
    white = vec[:, ok] / np.sqrt(val[ok])
    x = np.hstack([k @ white, np.ones((len(k), 1))])
    models = []
    for g in langs:
        y = np.array([1.0 if docs[i].lang == g else -1.0 for i in train])
        w = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        ridge = np.eye(x.shape[1]) * sk.RIDGE
        ridge[-1, -1] = 0
        models.append(np.linalg.solve((x.T * w) @ x + ridge, (x.T * w) @ y))
    got = {r.doc_id: r for r in sk.op5_string_kernel(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, r in docs.items():
        if len(r.text.encode()) < 2:
            assert got[i].lang is None
            continue
        s = [float(np.append(row(i) @ white, 1) @ m) for m in models]
        top = sorted(s)[-2:]
        assert abs(got[i].score - top[1]) < 2e-3 and (got[i].lang == langs[int(np.argmax(s))] or top[1] - top[0] < 4e-3)
