"""Stateful rules on a stream: event-time windows and deduplication, each with a batch twin.

State is kept per group and window, or per key, and leaves when the watermark (the largest event
time so far less the allowed delay) has passed it; rows that come later than that are dropped. The
state is partitioned by its key, the window counts are summed up in each task first, and
a query that starts again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(
    df: DataFrame, time: str, keys: list[str], aggregates: list[Column], size: str, slide: str | None = None,
    delay: str | None = None,
) -> DataFrame:
    """One row per window and key: window_start, window_end, the keys and the aggregates.

    Tumbling windows of ``size``, or sliding ones that begin every ``slide``. On a stream ``delay`` is how late a
    row may be; a window appears once the watermark has passed its end. A batch gives all windows.
    Rows with a null time are in no window.
    """
    if df.isStreaming:
        if not delay:
            raise ValueError("a stream needs a delay, or its windows never end")
        df = df.withWatermark(time, delay)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = df.groupBy(window.alias("__window"), *keys).agg(*aggregates)
    taken = [c for c in grouped.columns if c != "__window" and c not in keys]
    return grouped.select(
        F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *keys, *taken
    )


def deduplicated(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row that arrives of each key; a key is remembered for ``delay`` after its row's time.

    On a batch the keys are deduplicated over the whole table, which is the same as long as the copies of a key
    lie within the delay.
    """
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends everything that has arrived to Parquet, exactly once, then stops."""
    return (
        df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start(path)
    )
