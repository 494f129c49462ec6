"""Feeds: each micro-batch of a stream as lines of a log that clients tail, with its number and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def publish(stream: DataFrame, log: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Start appending a stream's rows to a log of JSON lines {batch, at, row}; a batch that is written again replaces its own lines.

    Spark applies backpressure to sources, so no slow reader drops an event; readers filter the log by batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.lit(number).alias("batch"), F.current_timestamp().alias("at"), F.struct("*").alias("row"))
        rows.write.mode("overwrite").json(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def since(spark, log: str, batch: int) -> DataFrame:
    """Rows of the feed after a batch: what a client that saw that one has missed."""
    return spark.read.json(log).where(F.col("batch") > batch)
