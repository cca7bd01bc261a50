"""Quality classifier by supervised subword embeddings.

A document is the average of the learned vectors of its hashed words, pairs of neighbouring words and byte n-grams without
white space inside; a softmax over it gives the class: poor, good or toxic. `prior` more occurrences of one feature that all
texts have draw short texts towards what is usual. A pair's hash is that of the XOR of its words, so a word said twice is the same pair whatever the word. Vectors and output weights are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents (`train_rows`, the
rows with the least hash of doc_id), in one task: the driver gets the folded table only. Both layers are linear, so for scoring each bucket's
vector is folded with the output weights into one number a class, and a document is scored by
table look-ups and sums over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import free, map_arrow, table

BUCKET_BITS = 17
NGRAMS = (3, 4)
DIM = 8
EPOCHS = 10
#: Steps of the training, at least: few texts are gone through more often.
MIN_STEPS = 4000
RATE = 0.6
PRIOR = 6
#: Labelled documents the model is fitted on, at most.
TRAIN_ROWS = 6000
#: Features of the training texts in one block. Its arrays exceed 32 MB, so malloc gives them back to the system at once: the worker that trains lives on.
BLOCK = 1 << 23
SEED = 7
THRESHOLD = 0.6
POOR, GOOD, TOXIC = range(3)

_MUL = np.uint32(2654435761)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _ngram_buckets(buf: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from each position on (n of 3 or 4); one entry per position, the last n - 1 are of no use."""
    v = buf.astype(np.uint32)
    x = v.copy()
    for t in range(1, n):
        x[:-t] |= v[t:] << np.uint32(8 * t)
    x += np.uint32((n * 0x9E3779B1) & 0xFFFFFFFF)
    x ^= x >> np.uint32(15)
    x *= _MUL
    return x >> np.uint32(32 - BUCKET_BITS)


def _spaced(buf: np.ndarray, n: int) -> np.ndarray:
    """Whether the n bytes from each position on have white space between the first and the last."""
    space = _SPACE[buf]
    out = np.zeros(len(buf), bool)
    for t in range(1, n - 1):
        out[:-t] |= space[t:]
    return out


def _word_buckets(h: np.ndarray) -> np.ndarray:
    return (h >> tv.U64(64 - BUCKET_BITS)).astype(np.uint32)


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text's features, the prior aside."""
    buf, off = tv.column_bytes(texts)
    for r in range(len(off) - 1):
        b = buf[off[r] : off[r + 1]]
        h, _, _ = tv.words(b, np.array([0, len(b)]))
        parts = [_word_buckets(h), _word_buckets(tv.mix(h[:-1] ^ h[1:]))]
        for n in NGRAMS:
            m = max(0, len(b) - n + 1)
            parts.append(_ngram_buckets(b, n)[:m][~_spaced(b, n)[:m]])
        yield np.unique(np.concatenate(parts), return_counts=True)


def train(texts: pa.Array, labels: np.ndarray, classes: int = 3, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, prior: int = PRIOR, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings, the last one being the prior's; output weights). A step on the embeddings is scaled by the text's sum of squared shares, so that long texts move as far as short ones."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, ((1 << BUCKET_BITS) + 1, dim)).astype(np.float32)
    out = np.zeros((dim, classes), np.float32)
    data, room, at = [], 0, 0
    for f, c in bags(texts):
        if at + len(f) > room:
            room, at = max(BLOCK, len(f)), 0
            buckets, shares = np.empty(room, np.uint32), np.empty(room, np.float32)
        f_, s = buckets[at : at + len(f)], shares[at : at + len(f)]
        f_[:], s[:] = f, c / (c.sum() + prior)
        at += len(f)
        data.append((f_, s, np.float32(1 - s.sum()), 1 / float(s @ s)) if len(f) else None)
    epochs = max(epochs, -(-MIN_STEPS // max(1, len(data))))
    steps, total = 0, max(1, epochs * len(data))
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            lr = rate * (1 - steps / total)
            steps += 1
            if data[i] is None:
                continue
            f, s, rest, scale = data[i]
            hidden = s @ emb[f] + rest * emb[-1]
            z = hidden @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            emb[f] -= (lr * scale) * s[:, None] * back
            emb[-1] -= lr * back
    return emb, out


def fold(emb: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Per bucket, what its presence adds to each class's logit, less what it adds to the class of good documents."""
    z = emb @ out
    return np.ascontiguousarray((z - z[:, GOOD : GOOD + 1]).astype(np.float32).T)


def score(texts: pa.Array, weights: np.ndarray, prior: int = PRIOR) -> np.ndarray:
    """texts x classes: probabilities; NaN for a text without features (one without a word, of fewer than three bytes)."""
    buf, off = tv.column_bytes(texts)
    got = [np.zeros((0, len(weights)))]
    for i, j in tv.chunks(off):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        h, _, first = tv.words(b, o)
        count = np.diff(first) + np.maximum(0, np.diff(first) - 1)
        grams = []
        for n in NGRAMS:
            end = np.maximum(o[1:] - n + 1, o[:-1])
            good = ~_spaced(b, n)
            acc = np.concatenate([[0], np.cumsum(good)])
            count = count + (acc[end] - acc[o[:-1]])
            grams.append((_ngram_buckets(b, n)[good], acc[o[:-1]], acc[end]))
        words, pairs = _word_buckets(h), _word_buckets(tv.mix(h[:-1] ^ h[1:]))
        last = np.maximum(first[1:] - 1, first[:-1])  # a row's pairs begin at its words but the last
        z = np.zeros((j - i, len(weights)))
        for k, w in enumerate(weights):
            if k == GOOD:
                continue
            acc = np.concatenate([[0], np.cumsum(w[words], dtype=np.float64)])
            z[:, k] = acc[first[1:]] - acc[first[:-1]] + prior * float(w[-1])
            acc = np.concatenate([[0], np.cumsum(w[pairs], dtype=np.float64)])
            at = np.minimum(first[:-1], len(pairs))
            z[:, k] += acc[np.minimum(last, len(pairs))] - acc[at]
            for g, start, end in grams:
                acc = np.concatenate([[0], np.cumsum(w[g], dtype=np.float64)])
                z[:, k] += acc[end] - acc[start]
        z /= (count + prior)[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[count == 0] = np.nan
        got.append(p)
    return np.concatenate(got)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """The folded table, from at most train_rows labelled documents (doc_id, quality and, if there is one, toxic); None where they are all of one class.

    A toxic document is toxic whatever its quality. A doc_id labelled more than once has its most frequent label (1 on a tie). Rows without an id or any label are passed over, as are documents without a text;
    of several texts of one id the least is taken. Labelled texts count whole, however long.
    """
    toxic = F.avg(F.col("toxic").cast("double")) >= 0.5 if "toxic" in labels.columns else F.lit(False)
    own = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.when(toxic, F.lit(TOXIC)).when(F.avg(F.col("quality").cast("double")) >= 0.5, F.lit(GOOD)).when(F.avg(F.col("quality").cast("double")).isNotNull(), F.lit(POOR)).alias("label"))
    own = own.where("label IS NOT NULL").withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(train_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(own), F.col("doc_id") == F.col("id"))

    def run(batches):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("place", "ascending"), ("id", "ascending")])
        y = t["label"].to_numpy()
        if len(set(y.tolist())) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([fold(*train(t["text"], y)).tobytes()], pa.binary())], ["weights"])

    got = rows.groupBy("place", "id", "label").agg(F.min("text").alias("text")).repartition(1).mapInArrow(run, "weights binary").collect()
    return np.frombuffer(got[0].weights, np.float32).reshape(3, -1) if got else None


def with_score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs and, last two, _vx_good and _vx_toxic (or longer free names): the probabilities that the document is good and that it is toxic.

    Null for a null or empty text, one without any feature, and where the labels are all of one class. Rows are scored one by one, so repeats and null ids change nothing; a text of
    any length is scored whole. Other columns pass through, whatever their names. Empty in, empty out.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))
    at, n = docs.columns.index("text"), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in free(docs, "_vx_good", "_vx_toxic"))])
    names = schema.names

    def run(batches):
        for b in batches:
            p = np.full((b.num_rows, 3), np.nan) if weights.value is None else score(b.column(at), weights.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(p[:, k], mask=np.isnan(p[:, k])) for k in (GOOD, TOXIC))], names=names)

    return map_arrow(docs, run, schema)


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_good, p_toxic, keep) of every document; one that isn't good, as toxic ones aren't, is not kept, what can't be scored is."""
    d = with_score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", F.col("_vx_good").alias("p_good"), F.col("_vx_toxic").alias("p_toxic"), F.coalesce(F.col("_vx_good") >= THRESHOLD, F.lit(True)).alias("keep"))
