"""Reads as a stream. Search and masking keep no state, so each micro-batch is classified as a table and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def classify_stream(reads: DataFrame, classify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes classify(batch) of a streaming frame to out/batch=N as Parquet. A batch run again replaces its own folder, so each read is there once."""

    def write(batch: DataFrame, number: int) -> None:
        classify(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
