"""Mixing sources to target weights by the cube method (balanced sampling).

Each source gets an inclusion probability that brings the expected token totals to the target
weights. The flight phase then moves the vector of probabilities at random within the
null space of the balancing constraints, until each document is in (1) or out (0): the
sums of the probabilities (documents) and of probability times tokens (tokens) stay what
they were. A step needs three undecided documents only, so the flight runs in bounded
chunks of a source side by side; the at most two that a chunk leaves undecided fly again per
source, then over all sources, and the last two land by dropping the token constraint.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import cut, drop_cut, free, plus, table

BUDGET = 0.7
TEMPERATURE = 2.0
CHUNK_ROWS = 20_000
SEED = 11
EPS = 1e-9


def rates(tokens: Mapping, budget: float = BUDGET, weights: Mapping | None = None, temperature: float = TEMPERATURE) -> dict:
    """Inclusion probability of each source.

    The sample shall have `budget` times all tokens, shared out by `weights` (token shares,
    need not add up to 1; a source without one gets none); by default a source's weight is its own share to the power
    1 / temperature. A source too small for its share is taken whole and the rest shared out among the others.
    """
    names = [s for s, t in tokens.items() if t > 0]
    size = np.array([float(tokens[s]) for s in names])
    w = (size / max(size.sum(), 1)) ** (1 / temperature) if weights is None else np.array([float(weights.get(s, 0)) for s in names])
    left, rate = budget * size.sum(), np.where(w > 0, -1.0, 0.0)
    while (open_ := rate < 0).any():
        share = left * w / w[open_].sum()
        full = open_ & (share >= size)
        if not full.any():
            rate[open_] = share[open_] / size[open_]
            break
        rate[full] = 1.0
        left -= size[full].sum()
    return dict.fromkeys(tokens, 0.0) | dict(zip(names, np.clip(rate, 0, 1).tolist()))


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but for two at most; sum(p) and sum(p * tokens) as before."""
    p = [float(x) for x in p]
    t = [float(x) for x in tokens]
    todo = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    for i, x in enumerate(p):
        if not EPS < x < 1 - EPS:
            p[i] = float(round(x))
    draws, held, at = rng.random(len(todo) + 1), [], 0
    for step in range(len(todo) + 1):
        while len(held) < 3 and at < len(todo):
            held.append(todo[at])
            at += 1
        if len(held) < 3:
            if len(held) < 2 or t[held[0]] != t[held[1]]:
                break
            a, b = held  # alike in tokens: one balances the other
            u, who = (1.0, -1.0), (a, b)
        else:
            a, b, c = held
            u, who = (t[b] - t[c], t[c] - t[a], t[a] - t[b]), (a, b, c)
            if not any(u):
                u = (1.0, -1.0, 0.0)
        up = min((((1 - p[i]) / x) if x > 0 else (-p[i] / x)) for i, x in zip(who, u) if x)
        down = min(((p[i] / x) if x > 0 else ((p[i] - 1) / x)) for i, x in zip(who, u) if x)
        by = up if draws[step] * (up + down) < down else -down
        for i, x in zip(who, u):
            p[i] += by * x
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        held = [i for i in held if 0 < p[i] < 1]
    return np.array(p)


def landing(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight without the token constraint, then a draw for the last one."""
    p = flight(p, np.zeros(len(p)), rng)
    last = (p > 0) & (p < 1)
    p[last] = rng.random(int(last.sum())) < p[last]
    return p


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) of every row: the number of words of its text (null: 0)."""
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            buf, off = tv.column_bytes(b.column(2))
            n = [np.zeros(0, np.int64)]
            for i, j in tv.chunks(off):
                n.append(tv.word_counts(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(np.concatenate(n))], names=["doc_id", "source", "n_tokens"])

    return d.mapInArrow(run, plus(d.drop("text"), "n_tokens", "long"))


def balanced_sample(docs: DataFrame, budget: float = BUDGET, weights: Mapping | None = None, temperature: float = TEMPERATURE, seed: int = SEED, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, source, n_tokens, pi): the documents of the sample.

    Per source, the sample's number of documents and of tokens are the expected ones up to
    the landing of at most two documents. Rows of one doc_id and source are one document
    with the sum of their tokens. A null doc_id is one document of its source, a null source is a
    source. Documents without words are drawn like others (0 tokens) at their source's rate;
    a source all of whose documents are so has rate 0. A text of any length counts whole. Documents that tie in tokens are told apart by their hashes. Same rows and seed, same sample. Empty in, empty out.
    The driver gets one row a source.
    """
    words = word_counts(docs)
    units = cut(words.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens")), "units")
    per = {r.source: r for r in units.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    rate = rates({s: r.t for s, r in per.items()}, budget, weights, temperature)
    spark = docs.sparkSession
    by = spark.createDataFrame([(s, rate[s], -(-per[s].n // chunk_rows)) for s in sorted(rate, key=lambda s: (s is None, s or ""))], "src string, pi double, chunks long")
    u = units.join(by, units["source"].eqNullSafe(by["src"])).drop("src")
    u = u.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "chunks")).drop("chunks").withColumn("p", F.col("pi"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("source string, n_tokens long, pi double, chunk long, p double").fields])

    def fly(last: bool):
        def run(key, t):
            names = np.unique(t["source"].fill_null("").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
            whole = pa.types.is_integer(t["doc_id"].type)
            ids = t["doc_id"].fill_null(-1).to_numpy().astype(np.int64) if whole else np.unique(t["doc_id"].cast(pa.string()).fill_null("").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1].astype(np.int64)
            t = t.take(pa.array(np.lexsort((names, ids, tv.mix(ids.view(tv.U64) ^ tv.U64(seed))))))
            rng = np.random.default_rng([seed, *str([k.as_py() for k in key]).encode()])
            n = t["n_tokens"].to_numpy()
            p = flight(t["p"].to_numpy(), n, rng)
            return t.set_column(t.schema.get_field_index("p"), "p", pa.array(landing(p, n, rng) if last else p))

        return run

    # Chunks of a source, then what each left of it, then what each source left.
    first = cut(u.groupBy("source", "chunk").applyInArrow(fly(False), schema), "flight")
    half = (F.col("p") > 0) & (F.col("p") < 1)
    drop_cut(units)
    second = cut(first.where(half).groupBy("source").applyInArrow(fly(False), schema), "flight")
    third = second.where(half).withColumn("chunk", F.lit(0).cast("long")).groupBy("chunk").applyInArrow(fly(True), schema)
    done = first.where("p = 1").unionByName(second.where("p = 1")).unionByName(third.where("p = 1"))
    return done.select("doc_id", "source", "n_tokens", "pi")


def keep_sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose document is in the sample; their columns as they are, whatever their names. As balanced_sample() for odd rows."""
    own, source = free(docs, "_vx_id", "_vx_source")
    s = balanced_sample(docs, **options).select(F.col("doc_id").alias(own), F.col("source").alias(source))
    # By hash at every size: a partition's ids are small against its texts, which needn't be sorted.
    return docs.join(s.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(s[own]) & docs["source"].cast("string").eqNullSafe(s[source]), "left_semi")


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced sample of all documents: (doc_id, source, n_tokens, pi)."""
    return balanced_sample(table(spark, sf_dir, "documents"))
