"""Language identification by string kernels.

The kernel of two texts is the normalised number of byte n-grams (n from 2 to 4, blended;
ASCII case folded) that are present in both, n-grams being hashed to 2**15 buckets. Landmark
texts give the Nyström approximation of it; on its features one kernel ridge regression per
language is solved against the rest. Folded together, a batch of texts is scored by two matrix products:
presence times landmarks, then kernel values times weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import free, map_arrow, table

BITS = 15
NGRAMS = (2, 3, 4)
#: Labelled texts the model is fitted on, at most, per language; the first of them are landmarks.
TRAIN_PER_LANGUAGE = 250
LANDMARKS_PER_LANGUAGE = 20
RIDGE = 1e-3
ROWS = 64


def presence(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x 2**BITS zeros and ones: which n-grams each text has."""
    rows = len(offsets) - 1
    out = np.zeros(rows << BITS, np.uint8)
    v = tv._LOWER[buf].astype(np.uint32)
    base = np.repeat(np.arange(rows, dtype=np.int64) << BITS, np.diff(offsets))
    end = np.repeat(offsets[1:], np.diff(offsets))
    x = v.copy()
    for n in range(2, max(NGRAMS) + 1):
        if len(v) < n:
            break
        x[: len(v) - n + 1] |= v[n - 1 :] << np.uint32(8 * (n - 1))
        if n in NGRAMS:
            m = len(v) - n + 1
            inside = np.arange(n, n + m) <= end[:m]
            h = (x[:m] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            out[(base[:m] + (h >> np.uint32(32 - BITS)).astype(np.int64))[inside]] = 1
    return out.reshape(rows, 1 << BITS)


def _pieces(offsets: np.ndarray):
    for i, j in tv.chunks(offsets):
        for s in range(i, j, ROWS):
            yield s, min(j, s + ROWS)


def _all_presence(texts: pa.Array) -> np.ndarray:
    buf, off = tv.column_bytes(texts)
    return np.vstack([presence(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in _pieces(off)] or [np.zeros((0, 1 << BITS), np.uint8)])


def kernel(x: np.ndarray, landmarks: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Normalised kernel values of presence rows x with the landmarks (root: the square roots of their numbers of n-grams)."""
    f = x.astype(np.float32)
    own = np.sqrt(f.sum(1))
    return (f @ landmarks.T) / np.maximum(own[:, None] * root, 1)


class Model:
    """languages, landmarks and the folded weights."""

    def __init__(self, texts: pa.Array, langs: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE):
        self.languages = sorted(set(langs))
        x = _all_presence(texts)
        y = np.array([self.languages.index(s) for s in langs])
        picked = np.concatenate([np.flatnonzero(y == c)[:landmarks_per_language] for c in range(len(self.languages))])
        self.landmarks = x[picked].astype(np.float32)
        self.root = np.sqrt(self.landmarks.sum(1))
        k = np.vstack([kernel(x[s : s + 256], self.landmarks, self.root) for s in range(0, len(x), 256)]).astype(np.float64)
        val, vec = np.linalg.eigh(k[picked])
        ok = val > 1e-6 * val.max()
        whiten = vec[:, ok] / np.sqrt(val[ok])  # W^(-1/2)
        phi = k @ whiten
        phi1 = np.hstack([phi, np.ones((len(phi), 1))])
        target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        # One class against the rest: both sides weigh the same in each regression.
        beta = np.empty((phi1.shape[1], len(self.languages)))
        for c in range(len(self.languages)):
            w = np.where(y == c, 0.5 / max(1, (y == c).sum()), 0.5 / max(1, (y != c).sum()))
            a = phi1.T @ (phi1 * w[:, None]) + ridge * np.diag([*np.ones(phi.shape[1]), 0.0])
            beta[:, c] = np.linalg.lstsq(a, phi1.T @ (w * target[:, c]), rcond=None)[0]
        self.weights = (whiten @ beta[:-1]).astype(np.float32)
        self.bias = beta[-1].astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """texts x languages; NaN rows for texts of fewer than two bytes."""
        buf, off = tv.column_bytes(texts)
        got = [np.zeros((0, len(self.languages)), np.float32)]
        for i, j in _pieces(off):
            x = presence(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            s = kernel(x, self.landmarks, self.root) @ self.weights + self.bias
            s[off[i + 1 : j + 1] - off[i:j] < 2] = np.nan
            got.append(s)
        return np.vstack(got)


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """A model from at most per_language labelled documents of each language (the least hashes of doc_id); None if no document has a language, an id and a text."""
    ids = docs.where("lang is not null and doc_id is not null and text is not null").select(F.col("doc_id").alias("_vx_id"), F.col("lang").cast("string").alias("_vx_lang"), F.xxhash64("doc_id").alias("_vx_order")).distinct()
    w = Window.partitionBy("_vx_lang").orderBy("_vx_order", "_vx_id")
    ids = ids.withColumn("_vx_n", F.row_number().over(w)).where(F.col("_vx_n") <= per_language).drop("_vx_n")
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    got = d.join(F.broadcast(ids), d["doc_id"] == ids["_vx_id"]).groupBy("_vx_order", "_vx_id", "_vx_lang").agg(F.min("text").alias("text")).toArrow()
    got = got.sort_by([("_vx_order", "ascending"), ("_vx_id", "ascending"), ("_vx_lang", "ascending")])
    return Model(got["text"], got["_vx_lang"].to_pylist()) if len(got) else None


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs and, last two, _vx_lang, the language of the highest score, and _vx_score (or longer free names); both null for a text that is null or shorter than two bytes, or without a model.

    Rows are scored one by one, repeated ones alike, a text of any length whole; of equal scores the first language in order is taken. Other columns pass through, whatever their names. Empty in, empty out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, n = docs.columns.index("text"), len(docs.columns)
    lang, score = free(docs, "_vx_lang", "_vx_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    out = schema.names

    def run(batches):
        for b in batches:
            m = shared.value
            s = m.scores(b.column(at)) if m is not None else np.full((b.num_rows, 1), np.nan)
            none = np.isnan(s[:, 0])
            best = np.argmax(np.where(none[:, None], 0, s), 1)
            names = np.array(m.languages if m is not None else [""], object)[best]
            top = s[np.arange(len(s)), best].astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(names, pa.string(), mask=none), pa.array(top, mask=none)], names=out)

    return map_arrow(docs, run, schema)


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, score) of every document, as the model has it."""
    docs = table(spark, sf_dir, "documents")
    return with_language(docs.select("doc_id", "text"), fit(docs)).select("doc_id", F.col("_vx_lang").alias("lang"), F.col("_vx_score").alias("score"))
