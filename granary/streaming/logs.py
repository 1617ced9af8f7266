"""Append-only logs as streams: every (seed, example) recorded once, events in windows, running maxima with an alarm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import schemas


def generation_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded generations as they are appended to JSON-lines files in a folder."""
    return spark.readStream.schema(schemas.GENERATION).json(folder)


def once(stream: DataFrame, keys: Sequence[str] = ("seed", "example_id"), event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first record of each key. With an event time the state of keys older than `late` is let go (keys repeated later than that pass again); without, it is kept for ever."""
    if event_time:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def append(stream: DataFrame, path: str, checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """Write what is there to a folder, exactly once, and stop; called again it goes on where it stopped."""
    return stream.writeStream.format(file_format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events in tumbling windows, closed when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, by: Sequence[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def memory_alarm(steps: DataFrame, limit: float, value: str = "memory", by: Sequence[str] = ("experiment_id",), every: int = 1) -> DataFrame:
    """Of each run's steps: running maximum, and alarm at the first step whose maximum is above the limit; of the others every `every`th is kept."""
    order = Window.partitionBy(*by).orderBy("step")
    peak = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = steps.withColumn("peak", peak).withColumn("alarm", (peak > limit) & (F.coalesce(before, F.lit(float("-inf"))) <= limit))
    return out.filter(F.col("alarm") | (F.col("step") % every == 0))
