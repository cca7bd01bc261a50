"""Continuous updates of an index from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import store as st
from ..plans.index import Index


def update_stream(stream: DataFrame, index: Index, checkpoint: str, **trigger) -> StreamingQuery:
    """Feeds (external_id, vector[, ts]) of a stream into the index's update log; an empty vector deletes.

    Each micro-batch is a directory named by its number that is overwritten if the batch is run again,
    so a batch counts once. Rows whose ts is not after the last ingestion are late and left out; without ts the time of the batch is taken.
    """

    def write(df: DataFrame, batch: int) -> None:
        index.refresh()
        last = index.meta["ingestion_timestamps"][-1] if index.meta["ingestion_timestamps"] else 0
        ts = F.col("ts") if "ts" in df.columns else F.lit(st.now_ms())
        rows = df.select(F.col("external_id").cast("long").alias("external_id"), F.col("vector").cast("array<float>").alias("vector"), ts.cast("long").alias("ts"))
        rows = rows.where((F.col("ts") > last) & F.col("external_id").isNotNull() & F.col("vector").isNotNull() & F.size("vector").isin(0, index.dimensions))
        path = f"{index.store.uri}/stream/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        marker = f"{index.store.uri}/stream_done/{batch}"
        if not index.store.files.exists(marker):
            index.store.append_updates(index.spark.read.schema(st.UPDATES).parquet(path))
            index.store.files.replace(marker, "")
            index._flag()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
