"""Structured Streaming: duplicates against what earlier batches registered, and a running ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators import dedup


def dedup_stream(docs: DataFrame, registry: str, out: str, checkpoint: str, distance: int = dedup.DISTANCE) -> StreamingQuery:
    """Documents (doc_id, text) of a stream that aren't near one that was registered before, or earlier in their batch.

    The registry is a Parquet folder of fingerprints, a partition for each batch: a batch that runs again overwrites its own
    partition and compares with the others only, so that a restart changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            fresh = dedup.keep(rows, distance)
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(registry)
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                known = spark.read.parquet(registry).where(F.col("batch") != number).select("fp")
                own = fresh.select("doc_id", dedup.simhash("text").alias("fp")).where("fp IS NOT NULL")
                near = dedup.near_fingerprints(own, known, distance).select("fp").distinct()
                fresh = fresh.join(own.join(near, "fp").select("doc_id"), "doc_id", "left_anti")
            fresh = fresh.persist()
            fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
            fresh.select(dedup.simhash("text").alias("fp")).where("fp IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{registry}/batch={number}")
            fresh.unpersist()
        finally:
            rows.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_cost(ledger: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, stage, calls, cost) of a stream of calls (ts, stage, cost); rows later than ``late`` are left out."""
    return ledger.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "stage").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))


def spent(ledger: DataFrame) -> DataFrame:
    """(stage, model, cost) as running totals, for output mode update or complete."""
    return ledger.groupBy("stage", "model").agg(F.sum("cost").alias("cost"))
