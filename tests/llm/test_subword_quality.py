import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vexel.llm import subword_quality as sq
from vexel.llm import textvec as tv
from vexel.llm.common import table

SF = "/root/testdata/sf0.1"


def features(text):
    """Bucket -> count, feature by feature."""
    b, out = text.encode(), {}

    def add(k):
        out[k] = out.get(k, 0) + 1

    hashes = [int(tv.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", b)]
    for h in hashes:
        add(h >> (64 - sq.BUCKET_BITS))
    for x, y in zip(hashes, hashes[1:]):
        add(int(tv.mix(np.array([x ^ y], np.uint64))[0]) >> (64 - sq.BUCKET_BITS))
    for n in sq.NGRAMS:
        for i in range(len(b) - n + 1):
            g = b[i : i + n]
            if not re.search(rb"[\t\n\x0b\x0c\r ]", g[1:-1]):
                x = (int.from_bytes(g, "little") + n * 0x9E3779B1) & 0xFFFFFFFF
                x ^= x >> 15
                add((x * 2654435761 & 0xFFFFFFFF) >> (32 - sq.BUCKET_BITS))
    return out


TEXTS = ["a", "ab", "abc def", "Some longer Text!! with été", "word " * 3000, "", "a a", "a b b b", "b", " ?! ", "?!?!"]


def test_features_one_by_one():
    for t, (f, c) in zip(TEXTS, sq.bags(pa.array(TEXTS))):
        assert dict(zip(f.tolist(), c.tolist())) == features(t)


def test_scores_are_those_of_the_averaged_vectors():
    rng = np.random.default_rng(0)
    emb, out = rng.normal(size=((1 << sq.BUCKET_BITS) + 1, 5)).astype(np.float32), rng.normal(size=(5, 3)).astype(np.float32)
    got = sq.score(pa.array(TEXTS), sq.fold(emb, out))
    for t, g in zip(TEXTS, got):
        f = features(t)
        if not f:
            assert np.isnan(g).all()
            continue
        hidden = (sum(c * emb[k].astype(float) for k, c in f.items()) + sq.PRIOR * emb[-1]) / (sum(f.values()) + sq.PRIOR)
        z = np.exp(hidden @ out)
        assert np.abs(g - z / z.sum()).max() < 1e-3


def test_query_against_brute_force(spark):
    """All rows of the query, by a trainer and a scorer that go feature by feature."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    label = {r.doc_id: 2 if r.toxic else r.quality for r in table(spark, sf, "labels").collect()}
    order = [r.doc_id for r in table(spark, sf, "labels").orderBy(F.xxhash64("doc_id")).collect() if r.doc_id in docs]
    rng = np.random.default_rng(sq.SEED)
    emb = rng.uniform(-1 / sq.DIM, 1 / sq.DIM, ((1 << sq.BUCKET_BITS) + 1, sq.DIM))
    out, bag, step = np.zeros((sq.DIM, 3)), {i: features(t) for i, t in docs.items()}, 0

    def hidden(f):
        return (sum(c * emb[k] for k, c in f.items()) + sq.PRIOR * emb[-1]) / (sum(f.values()) + sq.PRIOR)

    def softmax(z):
        z = np.exp(z - z.max())
        return z / z.sum()

    epochs = max(sq.EPOCHS, -(-sq.MIN_STEPS // len(order)))
    for _ in range(epochs):
        for i in rng.permutation(len(order)):
            lr = sq.RATE * (1 - step / (epochs * len(order)))
            step += 1
            f = bag[order[i]]
            n = sum(f.values()) + sq.PRIOR
            h = hidden(f)
            p = softmax(h @ out)
            p[label[order[i]]] -= 1
            back = out @ p
            out -= lr * np.outer(h, p)
            square = sum((c / n) ** 2 for c in f.values())
            for k, c in f.items():
                emb[k] -= lr * c / n / square * back
            emb[-1] -= lr * back
    got = {r.doc_id: r for r in sq.op8_subword_quality(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, f in bag.items():
        p = softmax(hidden(f) @ out)
        assert abs(got[i].p_good - p[1]) < 0.01 and abs(got[i].p_toxic - p[2]) < 0.01
        assert got[i].keep == (p[1] >= sq.THRESHOLD) or abs(p[1] - sq.THRESHOLD) < 0.01


def test_nulls_empty_repeats_names_and_no_labels(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "good text here"), (3, "good text here"), (4, "BAD!! BAD!!"), (None, "good " * 200_000)], "doc_id long, text string").withColumns({"quality": F.lit("x"), "_vx_good": F.lit(1), "a.b": F.lit(2)})
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    x = sq.with_score(d, labels)
    assert x.columns == [*d.columns, "_vx_good_", "_vx_toxic"]
    rows = x.collect()
    got = {r.doc_id: r["_vx_good_"] for r in rows}
    assert len(rows) == 6 and got[1] is None and got[2] is None and got[3] > 0.5 > got[4] and got[None] > 0.5
    for none in (labels.limit(0), labels.where("quality = 0")):
        assert sq.with_score(d, none).where("_vx_toxic is not null").count() == 0
    assert sq.with_score(d.limit(0), labels).count() == 0


def test_held_out_accuracy_of_the_query(spark, tmp_path):
    """On labels it has not seen: poor and toxic documents are rejected, good ones kept."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("doc_id % 4 <> 0").write.parquet(f"{tmp_path}/labels.parquet")
    got = sq.op8_subword_quality(spark, str(tmp_path)).join(labels.where("doc_id % 4 = 0"), "doc_id")
    kept = {(r.quality, r.toxic): r.kept for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    print(kept)
    assert kept[1, 0] > 0.99 and kept[0, 0] < 0.05 and kept[1, 1] < 0.1, kept


def test_training_stays_off_the_driver(spark, monkeypatch):
    """The model is fitted in a task, from the same texts in the same order as by hand; the driver never makes the features."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    text = {r.doc_id: r.text for r in docs.collect()}
    own = [r for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect() if r.doc_id in text]
    want = sq.fold(*sq.train(pa.array([text[r.doc_id] for r in own]), np.array([sq.TOXIC if r.toxic else sq.GOOD if r.quality else sq.POOR for r in own])))

    def on_the_driver(texts):
        raise AssertionError("features of the training texts on the driver")

    monkeypatch.setattr(sq, "bags", on_the_driver)
    got = sq.fit(docs, labels)
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-4


def test_training_keeps_eight_bytes_a_feature(monkeypatch):
    """A bucket and a share of each feature, and no second list of them; texts longer than a block are whole."""
    monkeypatch.setattr(sq, "BLOCK", 100_000)
    long = pa.array([" ".join(map(str, range(20_000))), "", "a short one", "two short ones"])
    cut = sq.train(long, np.array([0, 1, 1, 0]), epochs=1)
    monkeypatch.setattr(sq, "BLOCK", 10)
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(cut, sq.train(long, np.array([0, 1, 1, 0]), epochs=1)))
    monkeypatch.setattr(sq, "BLOCK", 100_000)
    rng = np.random.default_rng(0)
    texts = pa.array([" ".join(map(str, rng.integers(0, 10**6, 400))) for _ in range(600)])
    features = sum(len(f) for f, _ in sq.bags(texts))
    tracemalloc.start()
    sq.train(texts, np.arange(len(texts)) % 2, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * features + 12e6, (peak, features)
