"""Retention and scaling policies, and a multi-server queue, over rows (keys, epoch, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clip, d, flag
from .selection import quantiles

#: Cost ratios of a miss to an action; quantiles of the training scores that a threshold is searched among.
COST_RATIOS = (1, 2, 5, 10, 20, 50, 100)
GRID = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.975, 0.99)
UTIL_CAPACITY = 5.0
#: Fixed values of the simulated service: workers without and with an action, service time and limit in milliseconds.
LOW_WORKERS, HIGH_WORKERS = 2, 5
SERVICE_MS, SLA_MS, SLOT_MS = 1.5, 12.0, 1.0
#: Fixed value: the training epochs' share of a schedule (30 of 80).
TRAIN_SHARE = 0.375
LOW_FACTOR = 0.7


def adaptive_retention(split: DataFrame, keys: list[str], base: float, full: float = 12.0, q: float = 0.99) -> DataFrame:
    """Full resolution is kept where the score reaches the training scores' q-quantile.

    (keys, trigger_fraction, mean_scalars, storage_reduction, event_capture, precision) over the test rows.
    """
    limit = quantiles(split.where("split = 'train'"), keys, "p", {"limit": q})
    t = split.where("split = 'test'").join(limit, keys).withColumn("on", F.col("p") >= F.col("limit"))
    out = t.groupBy(*keys).agg(
        F.avg(F.col("on").cast("double")).alias("trigger_fraction"),
        F.avg(F.when(F.col("target") == 1, F.col("on").cast("double"))).alias("event_capture"),
        F.avg(F.when(F.col("on"), F.col("target").cast("double"))).alias("precision"),
    )
    scalars = d(base) + F.col("trigger_fraction") * d(full - base)
    return out.withColumn("mean_scalars", scalars).withColumn("storage_reduction", 1 - F.col("mean_scalars") / d(full))


def costs(rates: DataFrame, miss: str, action: str, ratios: tuple[int, ...] = COST_RATIOS) -> DataFrame:
    """Every row once per cost ratio, with cost = ratio * miss + action."""
    out = rates.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in ratios])))
    return out.withColumn("cost", F.col("ratio") * F.col(miss) + F.col(action))


def arrivals_telemetry(slots: DataFrame, keys: list[str], threshold: float = 0.9) -> DataFrame:
    """(keys, maximum, cnt, snapshot, event) of utilisation clip(n / 5, 0, 1) over an epoch's slots."""
    u = clip(F.col("n") / d(UTIL_CAPACITY), 0, 1)
    return slots.groupBy(*keys).agg(
        F.max(u).alias("maximum"), F.count_if(u >= d(threshold)).alias("cnt"),
        F.max(F.when(F.col("slot") == 0, u)).alias("snapshot"), F.max(flag(u >= d(threshold))).alias("event"),
    )


def simple_decisions(keys: list[str], event: str = "event", trigger: Column | None = None) -> dict[str, Column]:
    """Policies as columns: none, always, reactive (the last epoch's event) and, with a trigger, forecasting."""
    order = W.partitionBy(*keys).orderBy("epoch")
    out = {"no_action": F.lit(0), "always_on": F.lit(1), "reactive": F.coalesce(F.lag(event).over(order), F.lit(0)), "oracle": F.col(event)}
    return out | ({"forecast": flag(trigger)} if trigger is not None else {})


def delayed(decision: str, keys: list[str], delay: int) -> Column:
    """The decision as it takes effect `delay` epochs on; false before."""
    if not delay:
        return F.col(decision)
    return F.lag(decision, delay, 0).over(W.partitionBy(*keys).orderBy("epoch"))


def hysteresis(df: DataFrame, keys: list[str], high: Column, low: Column) -> Column:
    """1 from a high epoch on until two successive low ones. high and low exclude each other.

    On if the last high epoch is later than the last epoch that ends a pair of lows: two running maxima, no state.
    """
    order = W.partitionBy(*keys).orderBy("epoch")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    pair = low & F.coalesce(F.lag(flag(low)).over(order) == 1, F.lit(False))
    last = lambda c: F.max(F.when(c, F.col("epoch")))
    return df.withColumn("__high", high).withColumn("__pair", pair).withColumns(
        {"__h": last(F.col("__high")).over(upto), "__p": last(F.col("__pair")).over(upto)}
    ).withColumn("active", flag(F.coalesce(F.col("__h") > F.coalesce("__p", F.lit(-1)), F.lit(False)))).drop("__high", "__pair", "__h", "__p")


def search_threshold(train: DataFrame, keys: list[str], ratio: float, grid: tuple[float, ...] = GRID, tie: float = 1e-12) -> DataFrame:
    """(keys, threshold, cost, action_rate): the grid quantile of p of least cost, of least action among equals.

    Candidates are an array on each key's row, exploded against that key's own training rows.
    """
    cand = train.groupBy(*keys).agg(F.array_distinct(F.percentile("p", list(grid))).alias("c"))
    c = train.join(cand, keys).select(*keys, "p", "target", F.explode("c").alias("threshold"))
    on = flag(F.col("p") >= F.col("threshold"))
    miss = F.avg((F.col("target") * (1 - on)).cast("double"))
    r = c.groupBy(*keys, "threshold").agg(miss.alias("miss"), F.avg(on.cast("double")).alias("action_rate"))
    r = r.withColumn("cost", d(ratio) * F.col("miss") + F.col("action_rate"))
    step = F.round(F.col("cost") / d(tie * 1000)) if tie else F.col("cost")
    best = F.row_number().over(W.partitionBy(*keys).orderBy(step, "action_rate", F.col("threshold").desc())) == 1
    return r.withColumn("__b", best).where("__b").select(*keys, "threshold", "cost", "action_rate")


def search_delayed(
    epochs: DataFrame, keys: list[str], horizon: int, ratio: float, kind: str, grid: tuple[float, ...] = GRID, tie: float = 1e-12
) -> DataFrame:
    """(keys, threshold, cost, action_rate): the threshold of least training cost when actions take effect `horizon` epochs on.

    epochs: keys, epoch, p, target, train (its key's number of training epochs). Candidates are 0, the grid's quantiles of
    the p that have a training target, and 1. kind `predictive` acts where p reaches the threshold; `hybrid` also where
    the target is on, and stays on until two successive p under LOW_FACTOR of it. Of equal cost the least action, then the
    least threshold. Every key brings a bounded number of candidates, each tried on that key's training epochs only.
    """
    t = epochs.where((F.col("epoch") < F.col("train")) & (F.col("train") > horizon))
    known = F.when(F.col("epoch") < F.col("train") - horizon, F.col("p"))
    cand = t.groupBy(*keys).agg(F.percentile(known, list(grid)).alias("c"))
    cand = cand.select(*keys, F.explode(F.array_distinct(F.concat(F.array(d(0)), F.coalesce("c", F.array().cast("array<double>")), F.array(d(1))))).alias("threshold"))
    by = [*keys, "threshold"]
    # Dealt by threshold too, so that few keys are many tasks' work.
    each = t.join(cand, keys).repartition(int(epochs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    if kind == "hybrid":
        high = (F.col("p") >= F.col("threshold")) | (F.col("target") == 1)
        each = hysteresis(each, by, high, ~high & (F.col("p") < LOW_FACTOR * F.col("threshold"))).withColumnRenamed("active", "on")
    else:
        each = each.withColumn("on", flag(F.col("p") >= F.col("threshold")))
    acted = each.withColumn("act", delayed("on", by, horizon)).where(F.col("epoch") >= horizon)
    miss = F.avg((F.col("target") * (1 - F.col("act"))).cast("double"))
    r = acted.groupBy(*by).agg(miss.alias("miss"), F.avg(F.col("act").cast("double")).alias("action_rate"))
    r = r.withColumn("cost", d(ratio) * F.col("miss") + F.col("action_rate"))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.round(F.col("cost") / d(tie * 1000)), "action_rate", "threshold")) == 1
    return r.withColumn("__b", best).where("__b").select(*keys, "threshold", "cost", "action_rate")


def queue_latency(requests: DataFrame, keys: list[str], servers: int, service: float) -> DataFrame:
    """First-come queue with equal service times: latency of each request; the queue is empty when a key begins.

    requests: keys, k (place by arrival, from 0) and a (arrival). Requests go to the servers in turn, so of one server's
    j-th request the finish is service * (j + 1) + max over its i <= j of (a_i - i * service).
    """
    j = F.floor(F.col("k") / servers)
    lane = W.partitionBy(*keys, F.pmod("k", F.lit(servers))).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    finish = d(service) * (j + 1) + F.max(F.col("a") - d(service) * j).over(lane)
    return requests.withColumn("latency", finish - F.col("a"))


def run_metrics(latencies: DataFrame, keys: list[str], sla: float) -> DataFrame:
    return latencies.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.percentile("latency", 0.5).alias("p50"), F.percentile("latency", 0.95).alias("p95"),
        F.percentile("latency", 0.99).alias("p99"), F.avg((F.col("latency") > d(sla)).cast("double")).alias("sla_violations"),
    )


def simulate(requests: DataFrame, decided: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """A row per (by, keys) of what requests meet when an epoch's action decides between LOW_WORKERS and HIGH_WORKERS.

    requests: keys, epoch, k, a (milliseconds); decided: by, keys, epoch, event, act, of the epochs that count. Latencies
    under either number of workers are found once per request; a decision picks one of the two.
    """
    at = [*keys, "epoch"]
    low = queue_latency(requests, at, LOW_WORKERS, SERVICE_MS).withColumnRenamed("latency", "low")
    both = queue_latency(low, at, HIGH_WORKERS, SERVICE_MS).withColumnRenamed("latency", "high").select(*at, "low", "high")
    met = decided.join(both, at).withColumn("latency", F.when(F.col("act") == 1, F.col("high")).otherwise(F.col("low")))
    own = run_metrics(met, [*by, *keys], SLA_MS)
    p95 = met.groupBy(*by, *at).agg(F.percentile("latency", 0.95).alias("p95"))
    epochs = decided.join(p95, [*by, *at], "left").groupBy(*by, *keys).agg(
        F.count("*").alias("epochs"), F.avg(F.coalesce("p95", d(0))).alias("mean_epoch_p95"), F.avg(F.col("act").cast("double")).alias("scale_share"),
        (F.sum(F.col("event") * F.col("act")) / F.greatest(F.sum("event"), F.lit(1))).alias("coverage"),
        F.avg((F.col("event") * (1 - F.col("act"))).cast("double")).alias("missed"),
        F.sum(F.when(F.col("act") == 1, HIGH_WORKERS).otherwise(LOW_WORKERS)).cast("long").alias("worker_epochs"),
    )
    return epochs.join(own, [*by, *keys], "left")


def severe_epochs(p95: DataFrame, keys: list[str], train: Column, q: float = 0.9) -> DataFrame:
    """p95 rows with severe: above the q-quantile of the training epochs."""
    limit = p95.where(train).groupBy(*keys).agg(F.percentile("p95", q).alias("__limit"))
    return p95.join(limit, keys).withColumn("severe", flag(F.col("p95") > F.col("__limit"))).drop("__limit")


def coverage(decided: DataFrame, keys: list[str], target: str, action: str) -> DataFrame:
    """(keys, rows, events, missed, action_rate, coverage) of actions against events of the same epoch."""
    return decided.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(target).alias("events"),
        F.avg((F.col(target) * (1 - F.col(action))).cast("double")).alias("missed"), F.avg(F.col(action).cast("double")).alias("action_rate"),
        F.avg(F.when(F.col(target) == 1, F.col(action).cast("double"))).alias("coverage"),
    )
