"""Cross-site boilerplate lines, by the spread of each line over distinct sites.

Each line's hash gets a HyperLogLog sketch of the sites it stands on; sketches merge by
aggregation. Where the estimate is too near the threshold for the sketch to decide, the
sites of those lines alone are counted exactly. A line on at least `min_sites` sites is
boilerplate: it goes everywhere but in the first document (least doc_id) that has it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, cut, drop_cut, free, map_arrow, plus, table

MIN_SITES = 10
LG_K = 10
SIGMAS = 4.0
HASH_SEED = 42  # Spark's xxhash64()


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, row, site, h) per line that isn't blank; h is the hash of the line without spaces at its ends, row that of the document's id and text."""
    text = F.col("text").cast("string")
    d = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), F.col("source").cast("string").alias("site"), F.explode(F.split(text, "\n")).alias("line"))
    return d.select("doc_id", "row", "site", F.trim("line").alias("line")).where("line <> ''").select("doc_id", "row", "site", F.xxhash64("line").alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, sigmas: float = SIGMAS) -> DataFrame:
    """(h, first_doc): the lines on at least min_sites distinct sites. A null site is no site."""
    margin = max(1.0, sigmas * 1.04 / math.sqrt(1 << lg_k) * min_sites)
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_doc"))
    spread = spread.select("h", "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin)
    spread = cut(spread, "spread")
    sure = spread.where(F.col("sites") > min_sites + margin).select("h", "first_doc")
    near = spread.where(F.col("sites") <= min_sites + margin).select("h", "first_doc")
    exact = lines.join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    found = cut(sure.unionByName(near.join(exact.select("h"), "h", "left_semi")), "boilerplate")
    drop_cut(spread)
    return found


def _strip(text: bytes, drop: set[int]) -> tuple[bytes, int]:
    """text without the lines whose hashes are in `drop`, and how many they were."""
    lines = text.split(b"\n")
    kept = [x for x in lines if not (y := x.strip(b" ")) or xxhash.xxh64_intdigest(y, HASH_SEED) not in drop]
    return b"\n".join(kept), len(lines) - len(kept)


def strip_lines(docs: DataFrame, lines: DataFrame, found: DataFrame) -> DataFrame:
    """docs with `text` stripped of the boilerplate found, and one more column: how many lines went (null: no text).

    What each document loses is joined to it by id and text hash, so repeated rows and rows without an id are told
    apart by their texts and no list is longer than its document. Spark sends the lists to the tasks if they are few, else both sides are sorted.
    """
    removed, row, drop, own, key = free(docs, "_vx_removed", "_vx_row", "_vx_drop", "_vx_own", "_vx_key")
    hits = lines.join(found, "h").where("first_doc IS NULL OR doc_id IS NULL OR doc_id <> first_doc").groupBy("row", "doc_id").agg(F.collect_set("h").alias(drop))
    hits = hits.select(F.col("row").alias(own), F.col("doc_id").alias(key), drop)
    d = docs.withColumn(row, F.xxhash64("doc_id", F.col("text").cast("string")))
    d = d.join(hits, (F.col(row) == F.col(own)) & F.col("doc_id").eqNullSafe(F.col(key)), "left").select(*columns(docs), drop)
    at, n, out = docs.columns.index("text"), len(docs.columns), plus(docs, removed, "int")
    names = out.names

    def run(batches):
        for b in batches:
            col, todo = b.column(at), np.flatnonzero(np.asarray(b.column(n).is_valid()))
            gone, cols = np.zeros(b.num_rows, np.int32), b.columns[:n]
            if len(todo):
                text = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()
                for i in todo.tolist():
                    text[i], gone[i] = _strip(text[i], {h & 0xFFFFFFFFFFFFFFFF for h in b.column(n)[i].as_py()})
                cols[at] = pa.array(text, pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).cast(col.type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, mask=~np.asarray(col.is_valid()))], names=names)

    return map_arrow(d, run, out)


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with their boilerplate lines removed and, last, _vx_removed (or a longer free name): the number of lines that went.

    Lines are compared without spaces at their ends; blank lines always stay. A null text stays
    null (_vx_removed null) and an empty one empty. Ids are compared in their own type, so that strings have the
    least in their order. A document with a null doc_id is never the first to
    have a line; one with a null source adds no site. Repeated rows count as one site and as the same
    document. A text of any length is taken whole, as one task's row; a line of any length is one hash. Ties can't arise: the least id is one document.
    An empty table stays empty; other columns pass through, whatever their names.
    """
    lines = cut(line_table(docs), "lines")
    return strip_lines(docs, lines, boilerplate(lines, min_sites))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lines_removed) of every document, boilerplate lines removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d = without_boilerplate(docs)
    return d.select("doc_id", "text", F.col(d.columns[-1]).alias("lines_removed"))


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, pos, line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), spread AS (
  SELECT trim(line) AS line, min(doc_id) AS first_doc FROM lines WHERE trim(line) <> ''
  GROUP BY trim(line) HAVING count(DISTINCT source) >= {MIN_SITES}
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (s.line IS NULL OR l.doc_id = s.first_doc) AS text,
         CAST(count(*) FILTER (s.line IS NOT NULL AND l.doc_id <> s.first_doc) AS INT) AS lines_removed
  FROM lines l LEFT JOIN spread s ON trim(l.line) = s.line GROUP BY l.doc_id
)
SELECT doc_id, coalesce(text, '') AS text, lines_removed FROM kept
"""
