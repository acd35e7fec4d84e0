"""Sinks of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def json_lines(stream: DataFrame, line: Column, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a JSON object a line, a folder per batch. A batch that is run again after a failure replaces its own folder, so each row is
    there once. once: take what there is, and end."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select(F.to_json(line).alias("value")).write.mode("overwrite").text(f"{folder}/batch={number:012d}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
