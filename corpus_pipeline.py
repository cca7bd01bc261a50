"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.best_fit import pack_documents
from vexel.llm.common import columns, cut, drop_cut, table
from vexel.llm.cube_mix import keep_sample
from vexel.llm.line_spread import without_boilerplate
from vexel.llm.simhash_forest import drop_near_duplicates
from vexel.llm.subword_quality import THRESHOLD, with_score


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on `labels`, does not reject as poor or toxic.

    What it can't score (null or empty text) stays, repeated rows are judged alike, a text of any length is scored whole; an empty table stays empty.
    """
    d = with_score(docs, table(spark, sf_dir, "labels"))
    good = F.col(d.columns[-2])
    return d.where((good >= THRESHOLD) | good.isNull()).select(*columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines, n_chars brought up to date; one that consisted of nothing else goes.

    Null and empty texts stay, repeated rows are stripped alike, a text of any length is taken whole; an empty table stays empty.
    """
    d = without_boilerplate(docs)
    removed = F.col(d.columns[-1])
    d = d.where((removed == 0) | removed.isNull() | (F.trim(F.regexp_replace("text", r"\s+", "")) != ""))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return d.select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the least doc_id, and all that repeat none.

    Rows without an id or without words stay, of rows that repeat id and text one stays; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample in which each source has its target weight.

    Rows of one id and source stay or go together, null ids and sources count as values, documents without words are drawn like others; an empty table stays empty.
    """
    return keep_sample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of each document: (bin_id, doc_id, source, piece, first_token, n_tokens).

    Every row is packed, repeated ones into different bins, a long one in pieces; a document without words has one row without a bin; an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicate removal", near_duplicates),
    ("source mixing", mix),
    ("best-fit packing", packing),
]

#: No SQL: the classifier's and the sampler's decisions can't be had from SQL. tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
