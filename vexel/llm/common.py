"""Helpers of the corpus operators: lineage cuts, whole-table reads, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it. Where that is unset: a temporary one in local mode, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="vexel-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, outlives a lost executor. The table goes with drop_cut(), else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vexel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._vexel_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table that cut() wrote; only once nothing reads it any more."""
    fs, p = _hadoop(df.sparkSession, df._vexel_path)
    fs.delete(p, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever dots and signs their names have."""
    return [F.col(quoted(c)) for c in df.columns]


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of the graph with the undirected edges (a, b): root is the least node of its connected component.

    Alternating large-star and small-star rounds: each links a node's neighbours to the least
    of them, so the number of rounds grows with the logarithm of the longest chain; every
    round is one shuffle, written to the shared folder. Nodes without an edge to another do
    not appear. Self-loops, repeated edges and null ends are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rest = low.where("u <> m").select("u", F.col("m").alias("v"))
        big = large.unionByName(rest).distinct()  # every node above u, and u itself, now points at m
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # A fixed point is a set of stars: no node has two parents, and no parent has one.
        odd = new.groupBy("u").count().where("count > 1").select("u")
        more = odd.limit(1).unionByName(new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi").limit(1))
        done = more.isEmpty()
        drop_cut(e)
        e = new
        if done:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._vexel_path = e._vexel_path
            return out


def plus(df: DataFrame, name: str, kind: str) -> T.StructType:
    """df's schema with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow() for columns of any name: the batches have columns 0, 1, ...; what comes out is named by schema."""
    return df.toDF(*map(str, range(len(df.columns)))).mapInArrow(run, schema)
