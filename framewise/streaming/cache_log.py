"""Evaluations that arrive as a stream, kept in the append-only log (an extension; there is no streaming elsewhere)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own number, so that a batch run again replaces itself: every row once.

    ``written_at`` is the batch's number; :func:`framewise.operators.cache.latest`
    reads the log.  Only what has arrived is taken, then the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("written_at", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
