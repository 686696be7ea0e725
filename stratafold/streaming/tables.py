"""Streams into and out of snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import Table, conform


def append_stream(stream: DataFrame, table: Table, name: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a stream to a table, each batch in one snapshot and exactly once, also when a batch is run again after a failure.

    With an interval this goes on; without, it takes what is there and ends.
    """

    def add(batch: DataFrame, number: int) -> None:
        table.append_batch(conform(batch, table.snapshot().schema, batch.columns), name, number)

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows by key and tumbling window of event time, final once the watermark, `late` behind the newest event, has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")
