"""The test tables as panels of ordered samples, and the same in SQL for the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import d, smoothed_rate
from ..operators import clean, features, ranges, windows

K = 12
RESOURCE_LIMIT = 0.9
THRESHOLDS = {"80": 0.80, "90": 0.90, "95": 0.95, "99": 0.99}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits: sums of doubles depend on their order."""
    return df.select(*[F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by type in order of time: panel, i, n, raw, x (over the burst threshold)."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("panel"), "ts", "event_id", F.col("value").alias("raw"))
    o = clean.in_order(e, ["panel"], ["ts", "event_id"], keep=True).withColumn("x", F.col("raw"))
    return clean.normalise_bursts(o, ["panel"])


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.positional(event_samples(spark, sf_dir), K)


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.summarise(event_windows(spark, sf_dir), ["panel"], K)


def event_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.temporal_split(event_blocks(spark, sf_dir), ["panel"])


def event_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test transitions with p, a closed-form score with ties: the smoothed exceeding share."""
    return event_split(spark, sf_dir).withColumn("p", smoothed_rate("cnt", F.lit(K)))


_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _by_supplier(spark: SparkSession, sf_dir: str, then: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """then(resources, True) of suppliers whose lines one task may hold, with then(resources, False) of larger ones, if any.

    resources: lineitem by supplier as four resources in long form: panel, seq, resource, x; each by its own validity.
    """
    li = table(spark, sf_dir, "lineitem").withColumn("panel", F.col("l_suppkey"))
    li = li.select("panel", *_LINE_ORDER, "l_quantity", "l_discount", "l_tax")

    def resources(lines: DataFrame) -> DataFrame:
        return clean.valid_resources(clean.to_resources(lines.withColumnRenamed("i", "seq"), ["panel", "seq"], {
            "cpu": F.col("l_quantity") / d(50),
            "memory": clean.used_ratio("l_discount", F.lit(0.10)),
            "disk": clean.summed_rate("l_extendedprice", F.col("l_extendedprice") * F.col("l_discount")),
            "network": clean.summed_rate(F.col("l_extendedprice") * F.col("l_tax"), "l_quantity"),
        }))

    small, large = ranges.by_size(li, "panel")
    out = then(resources(ranges.placed_in_task(small, ["panel"], _LINE_ORDER)), True)
    return out if large is None else out.unionByName(then(resources(clean.in_order(large, ["panel"], _LINE_ORDER)), False))


def line_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by supplier as four resources in long form: panel, seq, resource, x; each by its own validity."""
    return _by_supplier(spark, sf_dir, lambda r, _: r)


def _resource_windows(r: DataFrame, in_task: bool) -> DataFrame:
    keys = ["panel", "resource"]
    if in_task:
        o = ranges.placed_in_task(r, keys, ["seq"]).where(F.col("n") >= clean.MIN_SAMPLES)
    else:
        o = clean.in_order(clean.at_least(r, keys), keys, ["seq"], keep=True)
    burst = clean.normalise_bursts(o.withColumn("raw", F.col("x")), keys, in_task=in_task)
    # One scale for all: a sample exceeds at 1. Ratios have a fixed limit, rates their key's threshold.
    x = F.when(F.col("resource").isin("cpu", "memory"), F.least(F.col("raw"), d(1)) / d(RESOURCE_LIMIT)).otherwise(F.col("x"))
    return windows.positional(burst.withColumn("x", x).drop("raw"), K)


def resource_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_supplier(spark, sf_dir, _resource_windows)


def resource_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_supplier(spark, sf_dir, lambda r, in_task: windows.summarise(_resource_windows(r, in_task), ["panel", "resource"], K))


def core_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by user, with the median of a size that varies by event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("panel"), "ts", "event_id", F.col("value").alias("x"), (1 + F.col("event_id") % 8).cast("double").alias("cores"))
    x = windows.positional(clean.in_order(e, ["panel"], ["ts", "event_id"]), K)
    return windows.summarise(x, ["panel"], K, 50.0, extra=[F.median("cores").alias("cores")])


def cpu_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda r, in_task: (ranges.placed_in_task if in_task else clean.in_order)(r.where("resource = 'cpu'"), ["panel"], ["seq"])
    o = _by_supplier(spark, sf_dir, place).where(F.col("n") >= clean.MIN_SAMPLES)
    return windows.positional(o.withColumn("x", F.least(F.col("x"), d(1))), K)


E_X = """
with s as (select event_type as panel, ts, event_id, value as raw, row_number() over (partition by event_type order by ts, event_id) - 1 as i,
                  count(*) over (partition by event_type) as n from events),
thr as (select panel, quantile_cont(raw, 0.99) as thr from s
        where i < greatest(1, cast(floor(cast(0.7 as double) * n) as bigint)) and raw > 0 group by panel),
x as (select s.panel, i, n, raw, cast(floor(i / 12.0) as bigint) as window_id, cast(i % 12 as bigint) as pos,
             least(greatest(raw / greatest(coalesce(thr, 1.0), 1e-12), 0.0), 100.0) as x, coalesce(thr, 1.0) as threshold
      from s left join thr on s.panel = thr.panel)"""
_SUMMARY = """max(case when pos = 0 then x end) as snapshot, max(case when pos = 6 then x end) as snapshot_late, avg(x) as mean,
  quantile_cont(x, 0.95) as p95, max(x) as maximum, cast(count(*) filter (where x >= 1) as bigint) as cnt,
  cast(max(case when x >= 1 then 1 else 0 end) as bigint) as event"""
E_W = E_X + f""",
w as (select panel, window_id, {_SUMMARY} from x group by panel, window_id having count(*) = 12)"""
E_T = E_W + """,
o as (select *, row_number() over (partition by panel order by window_id) - 1 as ord, count(*) over (partition by panel) as nw,
             lead(event) over (partition by panel order by window_id) as target,
             lead(window_id) over (partition by panel order by window_id) as nxt from w),
t0 as (select *, case when ord + 1 < floor(cast(0.7 as double) * nw) then 'train' else 'test' end as split
       from o where nxt = window_id + 1 and nw >= 50),
t as (select * from t0 where panel in (select panel from t0 group by panel
      having count(*) filter (where split = 'train') >= 20 and count(*) filter (where split = 'test') >= 5))"""
E_P = E_T + ", p as (select *, (cnt + cast(0.5 as double)) / 13.0 as p from t)"
L_X = """
with li as (select l_suppkey as panel, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as seq,
                   l_quantity / 50.0 as cpu, l_discount / cast(0.10 as double) as memory,
                   greatest(l_extendedprice, 0.0) + greatest(l_extendedprice * l_discount, 0.0) as disk,
                   greatest(l_extendedprice * l_tax, 0.0) + greatest(l_quantity, 0.0) as network from lineitem),
u as (select panel, seq, 'cpu' as resource, cpu as x from li where cpu between 0 and 1.000001 union all
      select panel, seq, 'memory', memory from li where memory between 0 and 1.000001 union all
      select panel, seq, 'disk', disk from li where disk >= 0 union all select panel, seq, 'network', network from li where network >= 0),
n as (select *, row_number() over (partition by panel, resource order by seq) - 1 as i, count(*) over (partition by panel, resource) as n from u),
m as (select * from n where n >= 12),
thr as (select panel, resource, quantile_cont(x, 0.99) as thr from m
        where i < greatest(1, cast(floor(cast(0.7 as double) * n) as bigint)) and x > 0 group by panel, resource),
x as (select m.panel, m.resource, i, n, cast(floor(i / 12.0) as bigint) as window_id, cast(i % 12 as bigint) as pos,
        case when m.resource in ('cpu', 'memory') then least(x, 1.0) / cast(0.9 as double)
             else least(greatest(x / greatest(coalesce(thr, 1.0), 1e-12), 0.0), 100.0) end as x
      from m left join thr on m.panel = thr.panel and m.resource = thr.resource)"""
L_W = L_X + f""",
w as (select panel, resource, window_id, {_SUMMARY} from x group by panel, resource, window_id having count(*) = 12)"""
C_X = L_X.replace("x as (select m.panel, m.resource", "x0 as (select m.panel, m.resource") + """,
x as (select panel, window_id, pos, i, least(cpu, 1.0) as x from (select m.panel, m.x as cpu, i, cast(floor(i / 12.0) as bigint) as window_id,
      cast(i % 12 as bigint) as pos from m where resource = 'cpu'))"""
DRAW = "(('0x' || substr(md5(cast({a} as varchar) || '-' || cast({b} as varchar)), 1, 8))::bigint % {n})"
