"""Reads as a stream: demultiplexed as they arrive, and counted per gene in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spotloom.operators.demux import demultiplex


def demux_stream(reads: DataFrame, codes: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each batch of a stream of reads, demultiplexed and written as Parquet below ``path``, one folder per batch: a
    batch that is run again after a failure replaces its own folder, so rows appear exactly once."""
    codes = codes.persist()

    def write(batch: DataFrame, no: int) -> None:
        demultiplex(batch, codes).write.mode("overwrite").parquet(f"{path}/batch={no}")

    w = reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def gene_counts_stream(transcripts: DataFrame, at: str = "recorded_at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, sample_id, gene_name, counts) per window of event time; rows later than ``late`` are dropped, and with
    them the state of windows that can no longer change."""
    t = transcripts.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    g = t.groupBy(F.window("_at", window), "sample_id", "gene_name").agg(F.count(F.lit(1)).alias("counts"))
    return g.select(F.col("window.start").alias("start"), "sample_id", "gene_name", "counts")


def deduplicated_stream(transcripts: DataFrame, key: str = "TXUID", at: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """Redelivered rows dropped, as long as they come within ``late`` of the first."""
    t = transcripts.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return t.dropDuplicatesWithinWatermark([key]).drop("_at")
