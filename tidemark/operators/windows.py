"""Windows of samples with exact completeness, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import d, flag, floor_id
from .ranges import joined
from .scratch import written

SAMPLE_SECONDS = 300


def positional(ordered: DataFrame, size: int) -> DataFrame:
    """Windows of `size` consecutive samples by their place i; pos within."""
    return ordered.withColumn("window_id", floor_id("i", size)).withColumn("pos", F.pmod("i", F.lit(size)).cast("long"))


def calendar(df: DataFrame, keys: list[str], t: str, order: list[str], seconds: int) -> DataFrame:
    """Windows of the clock; pos is the place within by time, ties by `order`."""
    w = df.withColumn("window_id", floor_id(t, seconds))
    at = W.partitionBy(*keys, "window_id").orderBy(t, *order)
    return w.withColumn("pos", (F.row_number().over(at) - 1).cast("long"))


def summarise(
    windowed: DataFrame, keys: list[str], size: int, threshold: float = 1.0, x: str = "x", second: int | None = None,
    extra: list[Column] | None = None,
) -> DataFrame:
    """One row per window of exactly `size` rows: snapshots, mean, p95, maximum, exceedance count and event.

    Duplicated samples count as rows. One grouped aggregate: the maximum and count combine before the shuffle.
    """
    second = min(size - 1, size // 2) if second is None else second
    over = F.col(x) >= d(threshold)
    w = windowed.groupBy(*keys, "window_id").agg(
        F.count("*").alias("rows"),
        F.max(F.when(F.col("pos") == 0, F.col(x))).alias("snapshot"),
        F.max(F.when(F.col("pos") == second, F.col(x))).alias("snapshot_late"),
        F.avg(x).alias("mean"),
        F.percentile(x, 0.95).alias("p95"),
        F.max(x).alias("maximum"),
        F.count_if(over).alias("cnt"),
        *(extra or []),
    )
    return w.where(F.col("rows") == size).drop("rows").withColumn("event", flag(F.col("cnt") > 0))


def threshold_counts(thresholds: dict[str, float], x: str = "x", second: int = 6) -> list[Column]:
    """Extra aggregates of summarise(): count and event flag per threshold, and what snapshots see of it."""
    out = []
    for name, u in thresholds.items():
        over = F.col(x) >= d(u)
        out += [
            F.count_if(over).alias(f"count_{name}"),
            F.max(flag(over)).alias(f"event_{name}"),
            F.max(F.when(F.col("pos") == 0, flag(over))).alias(f"snapshot_event_{name}"),
            F.sum(F.when(F.col("pos").isin(0, second), flag(over)).otherwise(0)).alias(f"snapshot_count_{name}"),
        ]
    return out


def widths(df: DataFrame, minutes: list[int], t: str = "t") -> DataFrame:
    """Every row once per window width: (.., minutes, window_id)."""
    w = df.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in minutes])))
    return w.withColumn("window_id", F.floor(F.col(t) / (F.col("minutes") * 60.0)).cast("long"))


def complete(df: DataFrame, keys: list[str], x: str = "x", threshold: float = 0.9) -> DataFrame:
    """(keys, minutes, window_id, maximum, cnt) of windows with a row per sampling interval."""
    w = df.groupBy(*keys, "minutes", "window_id").agg(
        F.count("*").alias("rows"), F.max(x).alias("maximum"), F.count_if(F.col(x) >= d(threshold)).alias("cnt")
    )
    return w.where(F.col("rows") == F.col("minutes") * 60 / SAMPLE_SECONDS)


def width_recall(samples: DataFrame, keys: list[str], minutes: list[int], thresholds: list[float]) -> DataFrame:
    """(minutes, threshold, event_windows, fixed_recall, random_recall, p95_recall, maximum_recall) over complete windows.

    samples: keys, i (place), x. A window of m minutes is m / 5 samples in their order; its first is the fixed snapshot.
    Windows are summarised once per width; thresholds are tried on the summaries' counts.
    """
    w = samples.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in minutes])))
    size = F.col("minutes") * 60 / SAMPLE_SECONDS
    w = w.withColumn("window_id", F.floor(F.col("i") / size)).withColumn("pos", F.pmod(F.col("i"), size.cast("long")))
    over = [F.count_if(F.col("x") >= d(u)).alias(f"c{k}") for k, u in enumerate(thresholds)]
    s = w.groupBy(*keys, "minutes", "window_id").agg(
        F.count("*").alias("rows"), F.max(F.when(F.col("pos") == 0, F.col("x"))).alias("first"), F.percentile("x", 0.95).alias("p95"), *over
    ).where(F.col("rows") == size)
    each = F.array(*[F.struct(d(u).alias("threshold"), F.col(f"c{k}").alias("count")) for k, u in enumerate(thresholds)])
    e = s.select("minutes", "rows", "first", "p95", F.explode(each).alias("e")).select("minutes", "rows", "first", "p95", "e.*").where("count > 0")
    share = lambda c: F.avg((F.col(c) >= F.col("threshold")).cast("double"))
    return e.groupBy("minutes", "threshold").agg(
        F.count("*").alias("event_windows"), share("first").alias("fixed_recall"), F.avg(F.col("count") / F.col("rows")).alias("random_recall"),
        share("p95").alias("p95_recall"), F.avg(d(1)).alias("maximum_recall"),
    )


def first_windows(blocks: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` windows in the order of their files and places: a bounded sample by definition."""
    return blocks.orderBy(*order).limit(most)


def contiguous(blocks: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Each window with its successor's columns next_*, where that is the very next window."""
    b = written(blocks, "windows")
    following = b.select(*keys, (F.col("window_id") - 1).alias("window_id"), *[F.col(c).alias(f"next_{c}") for c in carry])
    return joined(b, following, [*keys, "window_id"])
