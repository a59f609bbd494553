"""How well window summaries preserve threshold events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import Col, col, d, flag
from .ranges import joined
from .scratch import written
from .selection import quantiles

STATISTICS = ("snapshot", "mean", "p95", "maximum")


def share(found: Column, among: Column) -> Column:
    """Share of rows with `found` among those with `among`; null if there are none."""
    return F.avg(F.when(among, found.cast("double")))


def event_fidelity(blocks: DataFrame, keys: list[str], threshold: float = 1.0, schemes: tuple[str, ...] = STATISTICS) -> DataFrame:
    """(keys, scheme, windows, events, recall, false_positive_rate), all schemes in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("v")) for s in schemes])).alias("s")
    long = blocks.select(*keys, "event", each).select(*keys, "event", "s.scheme", (F.col("s.v") >= d(threshold)).alias("hit"))
    return long.groupBy(*keys, "scheme").agg(
        F.count("*").alias("windows"),
        F.sum("event").alias("events"),
        share(F.col("hit"), F.col("event") == 1).alias("recall"),
        share(F.col("hit"), F.col("event") == 0).alias("false_positive_rate"),
    )


def random_sample_recall(blocks: DataFrame, keys: list[str], cnt: str = "cnt", m: int = 12) -> DataFrame:
    """Expected recall of one and of two samples drawn from a window: q/m and 1 - C(m-q, 2) / C(m, 2)."""
    q = F.col(cnt).cast("double")
    return blocks.where(F.col(cnt) > 0).groupBy(*keys).agg(
        F.avg(q / m).alias("recall_one"),
        F.avg(1 - (m - q) * (m - q - 1) / float(m * (m - 1))).alias("recall_two"),
    )


def duration_error(blocks: DataFrame, keys: list[str], hits: Column, taken: int, cnt: str = "cnt", m: int = 12) -> DataFrame:
    """Mean absolute error of the exceeding share that `taken` snapshots see, over windows with an event."""
    seen, true = hits / float(taken), F.col(cnt) / float(m)
    return blocks.where(F.col(cnt) > 0).groupBy(*keys).agg(F.avg(F.abs(seen - true)).alias("duration_mae"))


def offset_recall(windowed: DataFrame, blocks: DataFrame, keys: list[str], threshold: float = 1.0) -> DataFrame:
    """(pos, recall) of a snapshot at each place of the window."""
    events = blocks.where("event = 1").select(*keys, "window_id")
    return windowed.join(events, [*keys, "window_id"]).groupBy("pos").agg(F.avg((F.col("x") >= d(threshold)).cast("double")).alias("recall"))


def persistence(pairs: DataFrame, keys: list[str], now: str = "event", then: str = "next_event") -> DataFrame:
    """2 x 2 counts of successive events, their conditional rates and the risk ratio."""
    n = lambda a, b: F.count_if((F.col(now) == a) & (F.col(then) == b)).alias(f"n{a}{b}")
    c = pairs.groupBy(*keys).agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))
    return persistence_rates(c)


def persistence_rates(counts: DataFrame) -> DataFrame:
    c = counts.withColumn("p0", F.try_divide(F.col("n01"), F.col("n00") + F.col("n01")))
    c = c.withColumn("p1", F.try_divide(F.col("n11"), F.col("n10") + F.col("n11")))
    return c.withColumn("risk_ratio", F.try_divide("p1", "p0"))


def concentration(blocks: DataFrame, entity: str, weight: str = "event") -> DataFrame:
    """Total, entities that contribute, effective number (sum w)^2 / sum w^2, and the greatest share."""
    e = blocks.groupBy(entity).agg(F.sum(weight).cast("double").alias("w"))
    total = F.sum("w")
    return e.agg(
        total.cast("long").alias("total"),
        F.count_if(F.col("w") > 0).alias("contributing"),
        F.try_divide(total * total, F.sum(F.col("w") * F.col("w"))).alias("effective"),
        F.try_divide(F.max("w"), total).alias("max_share"),
    )


def confusion(df: DataFrame, keys: list[str], true: Column, found: Column) -> DataFrame:
    n = lambda a, b, name: F.count_if((true if a else ~true) & (found if b else ~found)).alias(name)
    c = df.groupBy(*keys).agg(n(1, 1, "tp"), n(0, 1, "fp"), n(1, 0, "fn"), n(0, 0, "tn"))
    return c.withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))


def markov_diagnostic(counts: DataFrame) -> DataFrame:
    """Scores of the one-step rates as forecasts, in closed form from n00..n11: AP, Brier, log score and AUC.

    Two distinct scores only, so ranks and cumulated counts need no rows.
    """
    c = persistence_rates(counts)
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    pos, neg = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
    high, low = F.col("p1"), F.col("p0")
    brier = (F.col("n11") * (1 - high) ** 2 + F.col("n10") * high**2 + F.col("n01") * (1 - low) ** 2 + F.col("n00") * low**2) / n
    log = (F.col("n11") * F.ln(high) + F.col("n10") * F.ln(1 - high) + F.col("n01") * F.ln(low) + F.col("n00") * F.ln(1 - low)) / n
    ap = (F.col("n11") * high + F.col("n01") * pos / n) / pos
    auc = (F.col("n11") * F.col("n00") + d(0.5) * (F.col("n11") * F.col("n10") + F.col("n01") * F.col("n00"))) / (pos * neg)
    return c.select("*", ap.alias("average_precision"), brier.alias("brier"), log.alias("mean_log_score"), auc.alias("roc_auc"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, sd, rows, low, high); the quantiles by selection, for a group may have any number of distinct values."""
    v = written(df.select(*keys, value), "spread")
    of = v.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("rows"))
    return joined(of, quantiles(v, keys, value, {"low": 0.025, "high": 0.975}), keys, "left")


def least_per_group(df: DataFrame, keys: list[str], cost: str, tie: str) -> DataFrame:
    """The row of least cost in each group, by `tie` among equals."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(cost, tie)) == 1
    return df.withColumn("__first", first).where("__first").drop("__first")


def pivot_difference(df: DataFrame, keys: list[str], name: str, left: str, right: str, value: str) -> DataFrame:
    """Means of two named rows side by side, and right minus left; the names are given, so no pass finds them."""
    p = df.groupBy(*keys).pivot(name, [left, right]).agg(F.avg(value))
    return p.withColumn("difference", F.col(right) - F.col(left))


def reduction(a: Col, b: Col) -> Column:
    return 1 - col(a) / col(b)


def wire_summary(wire: DataFrame, mode: str, base: str, sums: tuple[str, ...] = ("requests", "bytes", "points")) -> DataFrame:
    """Totals per mode, per worker-window ratios and the byte reduction against the base mode."""
    t = wire.groupBy(mode).agg(*[F.sum(c).alias(c) for c in sums], F.sum("windows").alias("windows"))
    b = t.where(F.col(mode) == base).select(F.col("bytes").alias("__base"))
    t = t.join(F.broadcast(b))  # one row by construction
    per = [(F.col(c) / F.col("windows")).alias(f"{c}_per_window") for c in sums]
    return t.select(mode, *sums, "windows", *per, reduction("bytes", "__base").alias("byte_reduction"))


def window_detection(samples: DataFrame, keys: list[str], threshold: float, first: Column) -> DataFrame:
    """(keys, event, snapshot_detected, maximum_detected, maximum, exceedance_count) per window."""
    over = F.col("x") >= d(threshold)
    return samples.groupBy(*keys).agg(
        F.max(flag(over)).alias("event"),
        F.max(F.when(first, flag(over)).otherwise(0)).alias("snapshot_detected"),
        F.max(flag(over)).alias("maximum_detected"),
        F.max("x").alias("maximum"),
        F.count_if(over).alias("exceedance_count"),
    )
