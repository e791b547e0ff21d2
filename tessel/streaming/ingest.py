"""Streams into the vector table and out of job events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.operators.vector_index import KEY, VectorIndex, latest


def upsert_stream(rows: DataFrame, index: VectorIndex, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert each micro-batch into ``index``; a batch that is run again leads to the same table."""
    def merge(batch: DataFrame, _: int) -> None:
        index.add(latest(batch, KEY, F.col("created_at").desc_nulls_last()))

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def job_state_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Counts of job events per status and hour; late events within ``delay`` still count."""
    timed = events.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", delay)
    return timed.groupBy(F.window("updated_at", "1 hour"), "status").agg(F.count(F.lit(1)).alias("n"))
