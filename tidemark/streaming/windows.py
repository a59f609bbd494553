"""Structured Streaming forms of the window summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import d, flag


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def window_states(stream: DataFrame, t: str, x: str, seconds: int, threshold: float, late: str = "10 minutes", keys: list[str] | None = None, slide: int | None = None) -> DataFrame:
    """(keys, window_id, rows, maximum, cnt): incremental state of maximum and count per window.

    slide: seconds between windows' starts if they overlap; window_id counts starts then.

    State is a few numbers per open window; the watermark drops windows `late` after their end, and rows later than that.
    """
    width = f"{seconds} seconds"
    at = stream.withColumn("__t", F.col(t).cast("timestamp")).withWatermark("__t", late)
    g = at.groupBy(F.window("__t", width, f"{slide or seconds} seconds").alias("w"), *(keys or [])).agg(
        F.count("*").alias("rows"), F.max(x).alias("maximum"), F.count_if(F.col(x) >= d(threshold)).alias("cnt")
    )
    start = F.unix_timestamp(F.col("w.start"))
    return g.select(*(keys or []), F.floor(start / (slide or seconds)).cast("long").alias("window_id"), "rows", "maximum", "cnt")


def session_states(stream: DataFrame, t: str, x: str, gap: int, late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """(keys, first_us, last_us, rows, maximum): sessions, runs of a key's rows whose neighbours are at most `gap` seconds apart.

    State is a few numbers per open session; sessions that a row in between joins are merged. A session is emitted once the
    watermark is `gap` past its last row; rows later than that are dropped. Rows without a time are in no session.
    """
    at = stream.withColumn("__t", F.col(t).cast("timestamp")).withWatermark("__t", late)
    g = at.groupBy(F.session_window("__t", f"{gap} seconds").alias("w"), *(keys or [])).agg(F.count("*").alias("rows"), F.max(x).alias("maximum"))
    return g.select(*(keys or []), F.unix_micros("w.start").alias("first_us"), (F.unix_micros("w.end") - gap * 1_000_000).alias("last_us"), "rows", "maximum")


def run_available(states: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> None:
    """Process what is there and stop. With a checkpoint and an overwriting write, a batch that is repeated gives the same."""
    states.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def complete_windows(states: DataFrame, rows: int) -> DataFrame:
    """Windows with exactly the wanted rows, with their event."""
    return states.where(F.col("rows") == rows).withColumn("event", flag(F.col("cnt") > 0))


def flushed(states: DataFrame, raw_bytes: int, summary_bytes: int) -> DataFrame:
    """(window_id, raw_messages, summary_messages, bytes of either): what export per sample and per window would send."""
    return states.select(
        "window_id", F.col("rows").alias("raw_messages"), F.lit(1).cast("long").alias("summary_messages"),
        (F.col("rows") * raw_bytes).alias("raw_bytes"), F.lit(summary_bytes).cast("long").alias("summary_bytes"),
    )
