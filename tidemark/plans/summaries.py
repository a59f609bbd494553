"""Queries on sources, cleaning, windows, sketches and event fidelity."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sketch
from ..functions.scalar import clip, core_feature, d, expit, flag, floor_id, logit, near, softplus
from ..operators import clean, fidelity, windows
from ..operators.scratch import shared_folder
from ..sources import readers
from ..streaming import export
from ..streaming import windows as streaming
from .adapters import (
    C_X, E_W, E_X, K, L_W, L_X, THRESHOLDS, cpu_windows, event_blocks, event_samples, event_windows, line_resources,
    core_blocks, resource_blocks, rounded, table,
)

QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = ((lambda spark, sf_dir: rounded(f(spark, sf_dir))), sql)
        return f

    return add


_SCHEMES = "(values ('snapshot'), ('mean'), ('p95'), ('maximum')) v(scheme)"
_VALUE = "case scheme when 'snapshot' then snapshot when 'mean' then mean when 'p95' then p95 else maximum end"
_FIDELITY = f"""count(*) as windows, cast(sum(event) as bigint) as events,
  round(avg(case when event = 1 then cast({_VALUE} >= 1 as int) end), 6) as recall,
  round(avg(case when event = 0 then cast({_VALUE} >= 1 as int) end), 6) as false_positive_rate"""


@query(E_W + f" select scheme, {_FIDELITY} from w, {_SCHEMES} group by scheme")
def event_fidelity(spark, sf_dir):
    return fidelity.event_fidelity(event_blocks(spark, sf_dir), [])


@query(E_W + " select panel, window_id, round(snapshot, 6) as snapshot, round(snapshot_late, 6) as snapshot_late, round(mean, 6) as mean, round(p95, 6) as p95, round(maximum, 6) as maximum, cnt, event from w")
def window_summary_positional(spark, sf_dir):
    return event_blocks(spark, sf_dir)


@query("""with e as (select cast(floor(epoch(ts)) as bigint) as t, event_id, value as x from events),
w as (select cast(floor(t / 3600.0) as bigint) as window_id, x, row_number() over (partition by floor(t / 3600.0) order by t, event_id) - 1 as pos from e)
select window_id, round(max(case when pos = 0 then x end), 6) as snapshot, round(max(case when pos = 6 then x end), 6) as snapshot_late,
  round(avg(x), 6) as mean, round(quantile_cont(x, 0.95), 6) as p95, round(max(x), 6) as maximum,
  cast(count(*) filter (where x >= 30) as bigint) as cnt, cast(max(case when x >= 30 then 1 else 0 end) as bigint) as event
from w group by window_id having count(*) = 12""")
def window_summary_calendar(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "event_id", F.col("value").alias("x"))
    return windows.summarise(windows.calendar(e, [], "t", ["event_id"], 3600), [], 12, 30.0)


_COUNTS = ", ".join(
    f"cast(count(*) filter (where x >= {u}) as bigint) as count_{k}, cast(max(case when x >= {u} then 1 else 0 end) as bigint) as event_{k}, "
    f"cast(max(case when pos = 0 then case when x >= {u} then 1 else 0 end end) as bigint) as snapshot_event_{k}, "
    f"cast(sum(case when pos in (0, 6) and x >= {u} then 1 else 0 end) as bigint) as snapshot_count_{k}"
    for k, u in THRESHOLDS.items()
)


@query(C_X + f" select panel, window_id, {_COUNTS} from x group by panel, window_id having count(*) = 12")
def multi_threshold_counts(spark, sf_dir):
    extra = windows.threshold_counts(THRESHOLDS)
    b = windows.summarise(cpu_windows(spark, sf_dir), ["panel"], K, 0.9, extra=extra)
    return b.select("panel", "window_id", *[c for c in b.columns if c[-3:] in ("_80", "_90", "_95", "_99")])


@query("""with e as (select event_type as panel, cast(floor(epoch(ts)) as bigint) as t, value as x from events),
w as (select panel, m as minutes, cast(floor(t / (m * 60.0)) as bigint) as window_id, count(*) as n, max(x) as maximum,
        cast(count(*) filter (where x >= 30) as bigint) as cnt from e, (values (30), (60), (120)) v(m) group by all)
select panel, minutes, window_id, n as rows, round(maximum, 6) as maximum, cnt from w where n = minutes / 5""")
def window_width_sensitivity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("panel"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("x"))
    return windows.complete(windows.widths(e, [30, 60, 120]), ["panel"], "x", 30.0)


@query(E_X + """, wx as (select panel, m as minutes, cast(floor(i / (m / 5)) as bigint) as window_id, i % (m // 5) as pos, raw as x from x, (values (30), (60), (120)) v(m)),
ws as (select panel, minutes, window_id, count(*) as n, max(case when pos = 0 then x end) as first, quantile_cont(x, 0.95) as p95, list(x) as xs from wx group by all having count(*) = minutes / 5),
we as (select minutes, u as threshold, n, first, p95, len(list_filter(xs, lambda v: v >= u)) as c from ws, (values (cast(50.0 as double)), (100.0), (150.0), (200.0)) t(u))
select minutes, threshold, count(*) as event_windows, round(avg(cast(first >= threshold as int)), 6) as fixed_recall, round(avg(c / cast(n as double)), 6) as random_recall,
  round(avg(cast(p95 >= threshold as int)), 6) as p95_recall, cast(1.0 as double) as maximum_recall from we where c > 0 group by all""")
def width_threshold_recall(spark, sf_dir):
    x = event_samples(spark, sf_dir).select("panel", "i", F.col("raw").alias("x"))
    return windows.width_recall(x, ["panel"], [30, 60, 120], [50.0, 100.0, 150.0, 200.0])


@query(E_W + " select panel, window_id, round(maximum, 6) as maximum, cnt from w order by panel, window_id limit 40")
def first_windows(spark, sf_dir):
    return windows.first_windows(event_blocks(spark, sf_dir).select("panel", "window_id", "maximum", "cnt"), ["panel", "window_id"], 40)


#: Entities of the events with a size: panel is the user, cores vary by event.
_CORES = """with s as (select user_id as panel, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x, cast(1 + event_id % 8 as double) as cores from events),
c as (select panel, cast(floor(i / 12.0) as bigint) as window_id, max(x) as maximum, quantile_cont(cores, 0.5) as cores from s group by all having count(*) = 12)"""


@query(_CORES + " select panel, window_id, round(maximum, 6) as maximum, round(cores, 6) as cores, round(log2(greatest(cores, 1)), 6) as core_feature from c")
def window_cores(spark, sf_dir):
    b = core_blocks(spark, sf_dir)
    return b.select("panel", "window_id", "maximum", "cores", core_feature("cores").alias("core_feature"))


@query("select cast(floor((event_id % 1000) / 20.0) as bigint) as window_id, count(*) as samples, round(max(value), 6) as maximum from events group by 1")
def count_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("window_id", floor_id(F.col("event_id") % 1000, 20))
    return e.groupBy("window_id").agg(F.count("*").alias("samples"), F.max("value").alias("maximum"))


@query(E_X + " select distinct panel, round(threshold, 6) as threshold from x")
def burst_threshold(spark, sf_dir):
    return event_samples(spark, sf_dir).select("panel", "threshold").distinct()


@query(L_X + " select resource, count(*) as rows, round(min(x), 6) as low, round(max(x), 6) as high, round(avg(x), 6) as mean from u group by resource")
def resource_unpivot(spark, sf_dir):
    r = line_resources(spark, sf_dir)
    return r.groupBy("resource").agg(F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"))


@query("""with r as (select event_type as panel, try_cast(case when event_id % 7 = 0 then 'bad' else cast(value / 40 as varchar) end as double) as x,
  value as used, case when event_id % 5 = 0 then 0.0 else 60.0 end as capacity from events)
select panel, count(*) as rows, cast(count(*) filter (where x is not null) as bigint) as numbers,
  cast(count(*) filter (where x between 0 and 1.000001) as bigint) as valid_ratio,
  cast(count(*) filter (where capacity > 0 and used / nullif(capacity, 0) between 0 and 1.000001) as bigint) as valid_memory from r group by panel""")
def resource_validity(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, "bad").otherwise((F.col("value") / 40).cast("string"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("panel"), text.alias("x"), F.col("value").alias("used"), F.when(F.col("event_id") % 5 == 0, d(0)).otherwise(d(60)).alias("capacity"))
    e = clean.coerce(e, ["x"])
    return clean.audit(e, ["panel"], {"numbers": F.col("x").isNotNull(), "valid_ratio": clean.valid_ratio("x"), "valid_memory": F.coalesce(clean.valid_ratio(clean.used_ratio("used", "capacity")), F.lit(False))})


_PAYLOAD = "select event_type as panel, event_id as seq, cast(floor(epoch(ts)) as bigint) as t, cast(cast(floor(value / 25) as bigint) as varchar) as payload from events"


def _payloads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("panel"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.floor(F.col("value") / 25).cast("long").cast("string").alias("payload"))


@query(f"select panel, seq from (select *, lag(payload) over (partition by panel order by seq) as b from ({_PAYLOAD})) where b is null or b <> payload")
def dedup_exact(spark, sf_dir):
    return clean.drop_exact_repeats(_payloads(spark, sf_dir), ["panel"], ["seq"], "payload").select("panel", "seq")


@query(f"""with recursive e as ({_PAYLOAD}), r as (select *, row_number() over (partition by panel order by seq) as k from e),
f as (select panel, k, seq, t as last, payload as p, true as kept from r where k = 1 union all
  select r.panel, r.k, r.seq, case when r.payload = f.p and r.t - f.last between 0 and 2400 then f.last else r.t end,
    case when r.payload = f.p and r.t - f.last between 0 and 2400 then f.p else r.payload end,
    not (r.payload = f.p and r.t - f.last between 0 and 2400) from f join r on r.panel = f.panel and r.k = f.k + 1)
select panel, seq from f where kept""")
def dedup_short_interval(spark, sf_dir):
    return clean.drop_short_repeats(_payloads(spark, sf_dir), ["panel"], "seq", "t", "payload", 2400).select("panel", "seq")


@query("select panel, slot, seq from (select event_type as panel, cast(floor(epoch(ts) / 3600.0) as bigint) as slot, event_id as seq, row_number() over (partition by event_type, floor(epoch(ts) / 3600.0) order by event_id desc) as r from events) where r = 1")
def dedup_keep_last(spark, sf_dir):
    p = _payloads(spark, sf_dir).withColumn("slot", floor_id("t", 3600)).withColumn("files", F.lit(2))
    return clean.keep_last(p, ["panel"], "slot", ["seq"], "files").select("panel", "slot", "seq")


@query(f"""with e as ({_PAYLOAD}), k as (select panel, count(*) as kept from (select *, lag(payload) over (partition by panel order by seq) as b from e) where b is null or b <> payload group by panel),
h as (select panel, count(*) as complete_hours from (select panel, floor(t / 3600.0) as w from e group by 1, 2 having count(*) = 3) group by panel)
select e.panel, count(*) as rows, any_value(kept) as kept, coalesce(any_value(complete_hours), 0) as complete_hours from e left join k on e.panel = k.panel left join h on e.panel = h.panel group by e.panel""")
def clean_audit(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    kept = clean.drop_exact_repeats(p, ["panel"], ["seq"], "payload").groupBy("panel").agg(F.count("*").alias("kept"))
    hours = p.withColumn("w", floor_id("t", 3600)).groupBy("panel", "w").count().where("count = 3").groupBy("panel").agg(F.count("*").alias("complete_hours"))
    return clean.audit(p, ["panel"], {}).join(kept, "panel", "left").join(hours, "panel", "left").na.fill(0, ["complete_hours"])


@query(E_W + """, a as (select panel, count(*) as c from w group by panel), b as (select panel, count(*) as c from w where event = 1 and panel <> 'click' group by panel)
select coalesce(a.panel, b.panel) as panel, coalesce(a.c, 0) as "left", coalesce(b.c, 0) as "right", coalesce(b.c, 0) - coalesce(a.c, 0) as difference from a full join b on a.panel = b.panel""")
def window_count_difference(spark, sf_dir):
    w = event_blocks(spark, sf_dir)
    count = lambda x: x.groupBy("panel").agg(F.count("*").alias("c"))
    return clean.aligned_difference(count(w), count(w.where("event = 1 and panel <> 'click'")), ["panel"], "c")


@query(L_W + """, a as (select panel, resource, count(*) as c from w group by all), b as (select panel, resource, cast(floor(count(*) / 12.0) as bigint) as c from u where seq % 97 <> 5 group by all)
select coalesce(a.panel, b.panel) as panel, coalesce(a.resource, b.resource) as resource, coalesce(a.c, 0) as "left", coalesce(b.c, 0) as "right", coalesce(b.c, 0) - coalesce(a.c, 0) as difference
from a full join b on a.panel = b.panel and a.resource = b.resource where coalesce(a.c, 0) <> coalesce(b.c, 0)""")
def window_count_reconcile(spark, sf_dir):
    a = resource_blocks(spark, sf_dir).groupBy("panel", "resource").agg(F.count("*").alias("c"))
    b = line_resources(spark, sf_dir).where("seq % 97 <> 5").groupBy("panel", "resource").agg(F.floor(F.count("*") / 12).alias("c"))
    return clean.reconcile(a, b, ["panel", "resource"], "c")


@query(E_W + " select panel, window_id, round(maximum, 6) as maximum, bins from w join (select panel, window_id, count(distinct ceil(ln(x) / ln(1.01 / 0.99))) as bins from x where x > 0 group by all) using (panel, window_id)")
def summary_sketch_join(spark, sf_dir):
    x = event_windows(spark, sf_dir)
    b = event_blocks(spark, sf_dir)
    s = x.where("x > 0").groupBy("panel", "window_id").agg(F.count_distinct(sketch.bucket_key("x")).alias("bins"))
    s = clean.members(s, b, ["panel", "window_id"])
    return clean.one_to_one(b.select("panel", "window_id", "maximum"), s, ["panel", "window_id"])


@query(L_W + f" select resource, scheme, {_FIDELITY} from w, {_SCHEMES} group by resource, scheme")
def recall_multiresource(spark, sf_dir):
    return fidelity.event_fidelity(resource_blocks(spark, sf_dir), ["resource"])


@query(L_W + " select resource, count(*) as windows, count(distinct panel) as panels, cast(count(*) filter (where event = 1) as bigint) as event_windows from w group by resource")
def window_counts(spark, sf_dir):
    return resource_blocks(spark, sf_dir).groupBy("resource").agg(F.count("*").alias("windows"), F.count_distinct("panel").alias("panels"), F.count_if(F.col("event") == 1).alias("event_windows"))


@query(L_W + " select resource, round(avg(cnt / 12.0), 6) as recall_one, round(avg(1 - (12 - cnt) * (11 - cnt) / 132.0), 6) as recall_two from w where cnt > 0 group by resource")
def random_sample_recall(spark, sf_dir):
    return fidelity.random_sample_recall(resource_blocks(spark, sf_dir), ["resource"])


@query(L_W + " select resource, round(avg(abs((cast(snapshot >= 1 as int) + cast(snapshot_late >= 1 as int)) / 2.0 - cnt / 12.0)), 6) as duration_mae from w where cnt > 0 group by resource")
def duration_mae(spark, sf_dir):
    hits = flag(F.col("snapshot") >= 1) + flag(F.col("snapshot_late") >= 1)
    return fidelity.duration_error(resource_blocks(spark, sf_dir), ["resource"], hits, 2)


@query(E_W + " select x.pos, round(avg(cast(x.x >= 1 as int)), 6) as recall from x join w on x.panel = w.panel and x.window_id = w.window_id where event = 1 group by x.pos")
def offset_recall(spark, sf_dir):
    return fidelity.offset_recall(event_windows(spark, sf_dir), event_blocks(spark, sf_dir), ["panel"])


_PAIRS = ", q as (select *, lead(event) over (partition by panel order by window_id) as nx, lead(window_id) over (partition by panel order by window_id) as nw from w)"
_N = ", ".join(f"cast(count(*) filter (where event = {a} and nx = {b}) as bigint) as n{a}{b}" for a in (0, 1) for b in (0, 1))


@query(E_W + _PAIRS + f""", c as (select panel, {_N} from q where nw = window_id + 1 group by panel)
select panel, n00, n01, n10, n11, round(n01 / nullif(n00 + n01, 0)::double, 6) as p0, round(n11 / nullif(n10 + n11, 0)::double, 6) as p1,
  round((n11 / nullif(n10 + n11, 0)::double) / nullif(n01 / nullif(n00 + n01, 0)::double, 0), 6) as risk_ratio from c""")
def persistence(spark, sf_dir):
    return fidelity.persistence(windows.contiguous(event_blocks(spark, sf_dir), ["panel"], ["event"]), ["panel"])


@query(E_W + _PAIRS + f""", c as (select {_N} from q where nw = window_id + 1), r as (select *, n01 / (n00 + n01)::double as p0, n11 / (n10 + n11)::double as p1, (n00 + n01 + n10 + n11)::double as n from c)
select n00, n01, n10, n11, round(p0, 6) as p0, round(p1, 6) as p1, round(p1 / p0, 6) as risk_ratio, round((n11 * p1 + n01 * ((n01 + n11) / n)) / (n01 + n11), 6) as average_precision,
  round((n11 * (1 - p1) * (1 - p1) + n10 * p1 * p1 + n01 * (1 - p0) * (1 - p0) + n00 * p0 * p0) / n, 6) as brier,
  round((n11 * ln(p1) + n10 * ln(1 - p1) + n01 * ln(p0) + n00 * ln(1 - p0)) / n, 6) as mean_log_score,
  round((n11 * n00 + 0.5::double * (n11 * n10 + n01 * n00)) / ((n01 + n11) * (n00 + n10))::double, 6) as roc_auc from r""")
def markov_diagnostic(spark, sf_dir):
    c = fidelity.persistence(windows.contiguous(event_blocks(spark, sf_dir), ["panel"], ["event"]), []).select("n00", "n01", "n10", "n11")
    return fidelity.markov_diagnostic(c)


@query(L_W + ", e as (select panel, cast(sum(event) as double) as v from w group by panel) select cast(sum(v) as bigint) as total, cast(count(*) filter (where v > 0) as bigint) as contributing, round(sum(v) * sum(v) / sum(v * v), 6) as effective, round(max(v) / sum(v), 6) as max_share from e")
def kish_concentration(spark, sf_dir):
    return fidelity.concentration(resource_blocks(spark, sf_dir), "panel")


@query(L_X + " select resource, cast(count(*) filter (where abs(x - 1) <= 1e-12) as bigint) as strict, cast(count(*) filter (where abs(x - 1) <= 1e-8 + 1e-5) as bigint) as loose from u group by resource")
def near_equality(spark, sf_dir):
    return line_resources(spark, sf_dir).groupBy("resource").agg(F.count_if(near("x", 1.0)).alias("strict"), F.count_if(near("x", 1.0, 1e-8, 1e-5)).alias("loose"))


@query(E_W + ", b as (select panel, avg(case when window_id % 2 = 0 then maximum end) as a, avg(case when window_id % 2 = 1 then maximum end) as b from w group by panel) select panel, round(a, 6) as even, round(b, 6) as odd, round(b - a, 6) as difference from b")
def pivot_difference(spark, sf_dir):
    b = event_blocks(spark, sf_dir).withColumn("half", F.when(F.col("window_id") % 2 == 0, "even").otherwise("odd"))
    return fidelity.pivot_difference(b, ["panel"], "half", "even", "odd", "maximum")


@query(L_W + " select resource, round(avg(maximum), 6) as mean, round(stddev_samp(maximum), 6) as sd, count(*) as rows, round(quantile_cont(maximum, 0.025), 6) as low, round(quantile_cont(maximum, 0.975), 6) as high from w group by resource")
def group_spread(spark, sf_dir):
    return fidelity.spread(resource_blocks(spark, sf_dir), ["resource"], "maximum")


_KEY = "case when x > 0 then cast(ceil(ln(case when x > 0 then x else 1 end) / ln(cast(1.01 as double) / 0.99)) as bigint) else -10000 end"
_REP = "case when bucket = -10000 then 0.0 else least(greatest(2 / (1 + cast(1.01 as double) / 0.99) * pow(cast(1.01 as double) / 0.99, bucket), 0.0), 1.0) end"
_SKETCH = f", k as (select panel, window_id, {_KEY} as bucket, count(*) as n from x group by all)"


@query(C_X + _SKETCH + " select bucket, cast(sum(n) as bigint) as n from k group by bucket")
def log_sketch_bins(spark, sf_dir):
    rows = sketch.sketch_rows(cpu_windows(spark, sf_dir), ["panel", "window_id"])
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


@query(C_X + _SKETCH + f""", f as (select panel, window_id, max({_REP}) as m, sum(case when {_REP} >= 0.9 then n else 0 end) as c,
  greatest(count(*) filter (where bucket <> -10000), 1) as bins from k group by all having sum(n) = 12), t as (select panel, window_id, max(x) as tm, cast(count(*) filter (where x >= 0.9) as bigint) as tc from x group by all having count(*) = 12)
select count(*) as windows, cast(count(*) filter (where tm >= 0.9) as bigint) as events, cast(count(*) filter (where tm >= 0.9 and m >= 0.9) as bigint) as tp,
  cast(count(*) filter (where tm < 0.9 and m >= 0.9) as bigint) as fp, cast(count(*) filter (where tm >= 0.9 and m < 0.9) as bigint) as fn,
  cast(sum(abs(tc - c)) as bigint) as count_error, round(avg(bins), 6) as mean_bins from f join t using (panel, window_id)""")
def log_sketch_fidelity(spark, sf_dir):
    x = cpu_windows(spark, sf_dir)
    b = windows.summarise(x, ["panel"], K, 0.9)
    s = sketch.sketch_summary(sketch.sketch_rows(x, ["panel", "window_id"]), ["panel", "window_id"], 0.9)
    j = b.join(s, ["panel", "window_id"])
    true, found = F.col("event") == 1, F.col("sketch_max") >= 0.9
    return j.agg(
        F.count("*").alias("windows"), F.count_if(true).alias("events"), F.count_if(true & found).alias("tp"),
        F.count_if(~true & found).alias("fp"), F.count_if(true & ~found).alias("fn"),
        F.sum(F.abs(F.col("cnt") - F.col("sketch_count"))).alias("count_error"), F.avg("sketch_bins").alias("mean_bins"),
    )


@query(C_X + """, f as (select panel, window_id, max(x) as tm, max(case when pos = 0 then x end) as s from x group by all having count(*) = 12),
c as (select panel, cast(count(*) filter (where tm >= 0.9 and s >= 0.9) as bigint) as tp, cast(count(*) filter (where tm < 0.9 and s >= 0.9) as bigint) as fp, cast(count(*) filter (where tm >= 0.9 and s < 0.9) as bigint) as fn, cast(count(*) filter (where tm < 0.9 and s < 0.9) as bigint) as tn from f group by panel)
select panel, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0)::double, 6) as recall, round(tp / nullif(tp + fp, 0)::double, 6) as "precision" from c""")
def snapshot_confusion(spark, sf_dir):
    b = windows.summarise(cpu_windows(spark, sf_dir), ["panel"], K, 0.9)
    return fidelity.confusion(b, ["panel"], F.col("event") == 1, F.col("snapshot") >= 0.9)


@query(C_X + _SKETCH + " select panel, window_id, cast(sum(n) as bigint) as samples, count(*) as bins from k group by all")
def sketch_merge(spark, sf_dir):
    x = cpu_windows(spark, sf_dir)
    keys = ["panel", "window_id"]
    rows = sketch.merged_halves(x, F.col("pos") < 6, keys)
    # The map form must agree with the rows.
    same = F.size(sketch.sketch_payload(sketch.merge_maps("a", "b"))) == F.col("bins")
    agree = F.when(~same, F.raise_error(F.lit("rows and map disagree")).cast("long")).otherwise(F.col("bins"))
    return rows.select(*keys, "samples", agree.alias("bins"))


@query(E_W + " select panel, window_id, round(mean, 6) as mean, round(p95, 6) as exact_p95, round(maximum, 6) as maximum, round(maximum, 6) as maximum_of_two, cnt as count_of_two from w")
def state_merge(spark, sf_dir):
    keys, methods = ["panel", "window_id"], ["mean", "exact_p95", "maximum", "maximum_count"]
    whole = F.count("*").over(W.partitionBy(*keys)) == K
    x = event_windows(spark, sf_dir).withColumn("whole", whole).where("whole")
    merged = sketch.merge_states(*[sketch.window_states(x.where(c), keys, methods, 1.0) for c in ("pos < 6", "pos >= 6")], keys, methods)
    out = sketch.finish_states(merged, keys, methods)
    return out.select(*keys, "mean", "exact_p95", "maximum", F.col("maximum_count.maximum").alias("maximum_of_two"), F.col("maximum_count.n").alias("count_of_two"))


@query(C_X + _SKETCH + """, b as (select panel, window_id, greatest(count(*) filter (where bucket <> -10000), 1) as bins from k group by all having sum(n) = 12)
select round(avg(12 + 2 + 6 * bins), 6) as sketch_bytes, cast(24 as bigint) as max_count_bytes, cast(108 as bigint) as raw_bytes, round(1 - 24 / 108.0::double, 6) as max_count_reduction, round(1 - avg(14 + 6 * bins) / 108.0, 6) as sketch_reduction, round(avg(2 + 6 * bins), 6) as sketch_state from b""")
def payload_bytes(spark, sf_dir):
    x = cpu_windows(spark, sf_dir)
    full = windows.summarise(x, ["panel"], K, 0.9).select("panel", "window_id")
    s = sketch.sketch_summary(sketch.sketch_rows(x, ["panel", "window_id"]), ["panel", "window_id"], 0.9).join(full, ["panel", "window_id"])
    s = s.select(sketch.payload_bytes("log_sketch", "sketch_bins").alias("b"), sketch.payload_bytes("maximum_count").alias("m"), sketch.payload_bytes("raw").alias("r"), sketch.collector_bytes("log_sketch", "sketch_bins").alias("s"))
    t = s.agg(F.avg("b").alias("sketch_bytes"), F.max("m").alias("max_count_bytes"), F.max("r").alias("raw_bytes"), F.avg("s").alias("sketch_state"))
    return t.withColumn("max_count_reduction", fidelity.reduction("max_count_bytes", "raw_bytes")).withColumn("sketch_reduction", fidelity.reduction("sketch_bytes", "raw_bytes"))


def _varint(n: str) -> str:
    return "(1 + " + " + ".join(f"cast({n} >= {1 << 7 * k} as int)" for k in range(1, 6)) + ")"


@query(E_X + f""", b as (select panel, window_id, case when x > 0 then cast(ceil(ln(x) / ln({sketch.gamma_of(sketch.NATIVE_ERROR)!r}::double)) as bigint) end as k from x),
g as (select panel, window_id, cast(count(*) filter (where k is null) as bigint) as zeros, greatest(min(k), max(k) - 2047) as "offset", coalesce(max(k) - greatest(min(k), max(k) - 2047) + 1, 0) as bins from b group by all having count(*) = 12),
z as (select *, case when "offset" >= 0 then 2 * "offset" else -2 * "offset" - 1 end as zz from g),
st as (select *, case when bins > 0 then 1 + {_varint("8 * bins")} + 8 * bins else 0 end + case when coalesce("offset", 0) <> 0 then 1 + {_varint("zz")} else 0 end as store from z)
select panel, window_id, zeros, "offset", bins, cast(11 + 1 + {_varint("store")} + store + case when zeros > 0 then 9 else 0 end as bigint) as bytes from st""")
def native_sketch_bytes(spark, sf_dir):
    """The native sketch of every complete window: its store of consecutive buckets, and what it takes on the wire."""
    x = event_windows(spark, sf_dir)
    rows = sketch.sketch_rows(x, ["panel", "window_id"], error=sketch.NATIVE_ERROR)
    s = sketch.contiguous_store(rows, ["panel", "window_id"]).withColumn("bins", F.size("counts").cast("long"))
    whole = F.col("zeros") + F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n) == K
    return s.where(whole).select("panel", "window_id", "zeros", "offset", "bins", sketch.native_bytes("bins", "offset", "zeros").alias("bytes"))


@query(E_W + """, j as (select panel, window_id, '{"count":' || cnt || ',"v_max":' || round(maximum, 6) || ',"vm":"' || panel || '","window":' || window_id || '}' as payload from w)
select panel, window_id, payload, cast(length(payload) as bigint) as bytes from j""")
def payload_json(spark, sf_dir):
    b = event_blocks(spark, sf_dir)
    text = sketch.json_payload({"vm": "panel", "window": "window_id", "v_max": "maximum", "count": "cnt"})
    return b.select("panel", "window_id", text.alias("payload"), F.octet_length(text).cast("long").alias("bytes"))


@query("""with s as (select event_type as mode, count(*) as points, cast(sum(length(props)) as bigint) as bytes, count(distinct floor(event_id / 20)) as requests, count(distinct floor(epoch(ts) / 3600)) as windows from events group by 1)
select mode, requests, bytes, points, windows, round(requests / windows::double, 6) as requests_per_window, round(bytes / windows::double, 6) as bytes_per_window, round(points / windows::double, 6) as points_per_window,
  round(1 - bytes / (select bytes from s where mode = 'click')::double, 6) as byte_reduction from s""")
def wire_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("w", floor_id(F.unix_seconds(F.col("ts").cast("timestamp")), 3600))
    s = e.groupBy(F.col("event_type").alias("mode")).agg(
        F.count("*").alias("points"), F.sum(F.length("props").cast("long")).alias("bytes"),
        F.count_distinct(F.floor(F.col("event_id") / 20)).alias("requests"), F.count_distinct("w").alias("windows"),
    )
    return fidelity.wire_summary(s, "mode", "click")


@query(L_X + """, d as (select panel % 4 as worker, resource, window_id, panel, max(case when x >= 1 then 1 else 0 end) as event, max(case when pos = 0 and x >= 1 then 1 else 0 end) as s from x group by all)
select worker, resource, cast(sum(event) as bigint) as events, round(avg(case when event = 1 then s end), 6) as snapshot_recall, round(avg(case when event = 1 then event end), 6) as maximum_recall from d group by all""")
def detection_by_worker(spark, sf_dir):
    from .adapters import resource_windows

    x = resource_windows(spark, sf_dir).withColumn("worker", F.col("panel") % 4)
    det = fidelity.window_detection(x, ["worker", "resource", "window_id", "panel"], 1.0, F.col("pos") == 0)
    return det.groupBy("worker", "resource").agg(
        F.sum("event").alias("events"), F.avg(F.when(F.col("event") == 1, F.col("snapshot_detected").cast("double"))).alias("snapshot_recall"),
        F.avg(F.when(F.col("event") == 1, F.col("maximum_detected").cast("double"))).alias("maximum_recall"),
    )


@query("""select event_type as panel, round(avg(ln((value + 1) / 1000 / (1 - (value + 1) / 1000))), 6) as logit, round(avg(1 / (1 + exp(-value / 100))), 6) as expit,
  round(avg(greatest(value, 0) + ln(1 + exp(-abs(value)))), 6) as softplus, round(avg(log2(greatest(value, 1))), 6) as cores, round(avg(least(greatest(value, 10.0), 50.0)), 6) as clipped from events group by 1""")
def scalar_functions(spark, sf_dir):
    v = F.col("value")
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("panel"))
    return e.agg(F.avg(logit((v + 1) / 1000)).alias("logit"), F.avg(expit(v / 100)).alias("expit"), F.avg(softplus(v)).alias("softplus"), F.avg(core_feature(v)).alias("cores"), F.avg(clip(v, 10, 50)).alias("clipped"))


#: Windows that the watermark has closed: those whose end is not after the last event less ten minutes.
_HOURS = """select * from (select cast(floor(epoch(ts) / 3600.0) as bigint) as window_id, count(*) as rows, round(max(value), 6) as maximum, cast(count(*) filter (where value >= 30) as bigint) as cnt
from events group by 1) where (window_id + 1) * 3600 <= (select floor(epoch(max(ts)) * 1000) / 1000 from events) - 600"""


def _streamed(spark, states):
    """Results of a stream run to its end, each once, when the watermark has passed it."""
    from pyspark.errors import PySparkException

    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    try:
        streaming.run_available(states, lambda b, n: export.export_batch(b, n, f"{at}/out"), "append", f"{at}/log")
    except PySparkException as e:
        raise RuntimeError("the stream failed") from e
    return export.exported(spark, f"{at}/out", states.schema)


def _hours(spark, sf_dir):
    return _streamed(spark, streaming.window_states(streaming.read_stream(spark, sf_dir, "events"), "ts", "value", 3600, 30.0))


@query(f"select window_id, rows, maximum, cnt, cast(cnt > 0 as bigint) as event from ({_HOURS}) where rows = 12")
def stream_window_max_count(spark, sf_dir):
    return streaming.complete_windows(_hours(spark, sf_dir), 12)


@query(f"select window_id, rows as raw_messages, cast(1 as bigint) as summary_messages, rows * 20 as raw_bytes, cast(24 as bigint) as summary_bytes from ({_HOURS})")
def stream_export(spark, sf_dir):
    return streaming.flushed(_hours(spark, sf_dir), 20, 24)


@query("""with e as (select event_type as panel, cast(floor(epoch(ts)) as bigint) as t, value from events),
w as (select panel, t // 1800 - k as window_id, value from e, (values (0), (1), (2), (3)) v(k))
select panel, window_id, count(*) as rows, round(max(value), 6) as maximum, cast(count(*) filter (where value >= 30) as bigint) as cnt from w group by 1, 2
having window_id * 1800 + 7200 <= (select floor(epoch(max(ts)) * 1000) / 1000 from events) - 600""")
def stream_sliding_windows(spark, sf_dir):
    e = streaming.read_stream(spark, sf_dir, "events").withColumnRenamed("event_type", "panel")
    return _streamed(spark, streaming.window_states(e, "ts", "value", 7200, 30.0, keys=["panel"], slide=1800))


@query("""with e as (select user_id, epoch_us(ts) as t, value from events),
s as (select *, case when t - lag(t) over (partition by user_id order by t) <= 86400000000 then 0 else 1 end as fresh from e),
n as (select *, sum(fresh) over (partition by user_id order by t rows unbounded preceding) as no from s)
select user_id, min(t) as first_us, max(t) as last_us, count(*) as rows, round(max(value), 6) as maximum from n group by user_id, no
having max(t) + 86400000000 <= (select epoch_us(max(ts)) // 1000 * 1000 from events) - 600000000""")
def stream_sessions(spark, sf_dir):
    """Sessions of users: events at most a day apart."""
    return _streamed(spark, streaming.session_states(streaming.read_stream(spark, sf_dir, "events"), "ts", "value", 86400, keys=["user_id"]))


@query(None)
def table_manifest(spark, sf_dir):
    """All files of the tables, by their path below sf_dir."""
    below = rf".*/{re.escape(sf_dir.rstrip('/').rpartition('/')[2])}/(.+)$"
    return readers.inventory(spark, sf_dir, "*.parquet").select(F.regexp_extract("path", below, 1).alias("file"), "length", "sha256")
