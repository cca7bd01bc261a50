"""python -m vexel ingest|query|info ... : building and asking an index from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="vexel")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="build a version of an index from a vector file or table")
    a.add_argument("index_type", choices=["FLAT", "IVF_FLAT", "IVF_PQ", "VAMANA"])
    a.add_argument("source")
    a.add_argument("index")
    a.add_argument("--metric", default="SUM_OF_SQUARES")
    a.add_argument("--timestamp", type=int)
    for name in ("partitions", "num-subspaces", "l-build", "r-max-degree", "training-sample-size"):
        a.add_argument(f"--{name}", type=int)
    q = sub.add_parser("query", help="nearest neighbours of the vectors of a file or table, as Parquet")
    q.add_argument("index")
    q.add_argument("queries")
    q.add_argument("output")
    q.add_argument("-k", type=int, default=10)
    q.add_argument("--timestamp", type=int)
    q.add_argument("--k-factor", type=float, default=1.0)
    for name in ("nprobe", "l-search"):
        q.add_argument(f"--{name}", type=int)
    i = sub.add_parser("info", help="what an index is and which versions it has")
    i.add_argument("index")
    o = p.parse_args(args)

    from .plans import ingest, open_index
    from .sources import read_vectors

    spark = SparkSession.builder.getOrCreate()
    if o.command == "ingest":
        more = {k: v for k, v in vars(o).items() if k in ("partitions", "num_subspaces", "l_build", "r_max_degree", "training_sample_size") and v is not None}
        ingest(spark, o.index_type, o.index, source_uri=o.source, distance_metric=o.metric, index_timestamp=o.timestamp, **more)
    elif o.command == "query":
        v = read_vectors(spark, o.queries).selectExpr("external_id AS query_id", "CAST(vector AS array<float>) AS vector")
        open_index(spark, o.index, o.timestamp).query(v, o.k, nprobe=o.nprobe, k_factor=o.k_factor, l_search=o.l_search).write.parquet(o.output)
    else:
        for k, v in sorted(open_index(spark, o.index).meta.items()):
            print(f"{k}: {v}")


if __name__ == "__main__":
    main()
