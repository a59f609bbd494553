"""Queries on retention, scaling policies and the queue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import d
from ..operators import bootstrap, fidelity, policy
from ..operators.scratch import written
from .adapters import DRAW, E_P, event_scored, rounded, table

QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = ((lambda spark, sf_dir: rounded(f(spark, sf_dir))), sql)
        return f

    return add


@query(E_P + """, l as (select panel, quantile_cont(p, 0.99) as lim from p where split = 'train' group by panel),
a as (select p.panel, avg(cast(p >= lim as int)) as f, avg(case when target = 1 then cast(p >= lim as int) end) as c, avg(case when p >= lim then target end) as pr from p join l on p.panel = l.panel where split = 'test' group by p.panel)
select panel, round(f, 6) as trigger_fraction, round(c, 6) as event_capture, round(pr, 6) as "precision", round(2 + f * 10, 6) as mean_scalars, round(1 - (2 + f * 10) / 12, 6) as storage_reduction from a""")
def adaptive_retention(spark, sf_dir):
    return policy.adaptive_retention(event_scored(spark, sf_dir), ["panel"], 2.0)


#: Schedules taken from the events: a key per user (of 40), an epoch per 12 of its events, arrivals from their values.
_SLOTS = """with q as (select user_id % 40 as key, row_number() over (partition by user_id % 40 order by ts, event_id) - 1 as i, cast(floor(value / 10) as bigint) as n from events),
s0 as (select key, cast(floor(i / 12.0) as bigint) as epoch, cast(i % 12 as bigint) as slot, least(n, 9) as n from q),
e as (select key, epoch, max(least(greatest(n / 5.0::double, 0), 1)) as maximum, cast(count(*) filter (where n / 5.0 >= 0.9) as bigint) as cnt,
  max(case when slot = 0 then least(greatest(n / 5.0::double, 0), 1) end) as snapshot, cast(max(case when n / 5.0 >= 0.9 then 1 else 0 end) as bigint) as event from s0 group by all)"""


def _slots(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.col("user_id") % 40)
    i = F.row_number().over(W.partitionBy("key").orderBy("ts", "event_id")) - 1
    e = e.select("key", i.alias("i"), F.floor(F.col("value") / 10).cast("long").alias("n"))
    return e.select("key", F.floor(F.col("i") / 12).cast("long").alias("epoch"), (F.col("i") % 12).cast("long").alias("slot"), F.least("n", F.lit(9)).alias("n"))


def _epochs(spark, sf_dir):
    return policy.arrivals_telemetry(_slots(spark, sf_dir), ["key"] + ["epoch"])


@query(_SLOTS + " select key, epoch, round(maximum, 6) as maximum, cnt, round(snapshot, 6) as snapshot, event from e")
def controller_telemetry(spark, sf_dir):
    return _epochs(spark, sf_dir)


_DECIDED = _SLOTS + ", d as (select *, coalesce(lag(event) over (partition by key order by epoch), 0) as reactive, lag(event, 2, 0) over (partition by key order by epoch) as late from e)"
_RATES = """, r as (select policy, delay, count(*) as rows, cast(sum(event) as bigint) as events, avg(event * (1 - a)) as missed, avg(a) as action_rate, avg(case when event = 1 then a end) as coverage
 from (select event, 'no_action' as policy, 0 as delay, 0 as a from d union all select event, 'always_on', 0, 1 from d union all select event, 'reactive', 0, reactive from d union all select event, 'oracle', 0, event from d
 union all select event, 'reactive', 2, coalesce(lag(reactive, 2, 0) over (partition by key order by epoch), 0) from d union all select event, 'oracle', 2, late from d) group by all)"""


def _rates(spark, sf_dir):
    e = _epochs(spark, sf_dir)
    decided = e.withColumns(policy.simple_decisions(["key"]))
    out = None
    for name, delays in (("no_action", (0,)), ("always_on", (0,)), ("reactive", (0, 2)), ("oracle", (0, 2))):
        for delay in delays:
            acted = decided.withColumn("a", policy.delayed(name, ["key"], delay)).withColumn("policy", F.lit(name)).withColumn("delay", F.lit(delay))
            rates = policy.coverage(acted, ["policy", "delay"], "event", "a")
            out = rates if out is None else out.unionByName(rates)
    return out


@query(_DECIDED + _RATES + " select policy, delay, rows, events, round(missed, 6) as missed, round(action_rate, 6) as action_rate, round(coverage, 6) as coverage from r")
def policy_coverage(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(_DECIDED + _RATES + " select policy, delay, ratio, round(ratio * missed + action_rate, 6) as cost from r, (values (1), (2), (5), (10), (20), (50), (100)) v(ratio)")
def cost_sensitivity(spark, sf_dir):
    return policy.costs(_rates(spark, sf_dir), "missed", "action_rate").select("policy", "delay", "ratio", "cost")


@query(_DECIDED + _RATES + """ select delay, ratio, policy, round(cost, 6) as cost from (select *, row_number() over (partition by delay, ratio order by cost, policy) as k
 from (select policy, delay, ratio, ratio * missed + action_rate as cost from r, (values (1), (2), (5), (10), (20), (50), (100)) v(ratio))) where k = 1""")
def policy_winners(spark, sf_dir):
    c = policy.costs(_rates(spark, sf_dir), "missed", "action_rate")
    return fidelity.least_per_group(c, ["delay", "ratio"], "cost", "policy").select("delay", "ratio", "policy", "cost")


@query(_SLOTS + """, r as (select *, maximum >= 0.8 or event = 1 as high, not (maximum >= 0.8 or event = 1) and maximum < 0.56 as low from e),
f as (select *, low and coalesce(lag(low) over (partition by key order by epoch), false) as pair from r),
g as (select *, max(case when high then epoch end) over (partition by key order by epoch) as h, max(case when pair then epoch end) over (partition by key order by epoch) as p from f)
select key, epoch, cast(coalesce(h > coalesce(p, -1), false) as bigint) as active from g""")
def hysteresis(spark, sf_dir):
    high = (F.col("maximum") >= d(0.8)) | (F.col("event") == 1)
    low = ~high & (F.col("maximum") < d(0.8 * policy.LOW_FACTOR))
    return policy.hysteresis(_epochs(spark, sf_dir), ["key"], high, low).select("key", "epoch", "active")


#: Requests of an epoch: n per slot, spread within it; places by arrival.
_QUEUE = _SLOTS + """, a as (select key, epoch, slot * 10.0::double + j * 10.0::double / n as a from s0, range(9) g(j) where j < n),
k as (select *, row_number() over (partition by key, epoch order by a) - 1 as k from a),
z as (select key, epoch, k, a, 4.0::double * (floor(k / 2) + 1) + max(a - 4.0::double * floor(k / 2)) over (partition by key, epoch, k % 2 order by k) - a as latency from k)"""


def _latencies(spark, sf_dir):
    s = _slots(spark, sf_dir).where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    a = s.select("key", "epoch", (F.col("slot") * d(10) + F.col("j") * d(10) / F.col("n")).alias("a"))
    k = a.withColumn("k", (F.row_number().over(W.partitionBy("key", "epoch").orderBy("a")) - 1).cast("long"))
    return policy.queue_latency(k, ["key", "epoch"], 2, 4.0)


@query(_QUEUE + " select key, epoch, count(*) as requests, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.95), 6) as p95, round(quantile_cont(latency, 0.99), 6) as p99, round(avg(cast(latency > 12 as int)), 6) as sla_violations from z group by all")
def fcfs_queue(spark, sf_dir):
    return policy.run_metrics(_latencies(spark, sf_dir), ["key", "epoch"], 12.0)


@query(_QUEUE + """, m as (select key, epoch, quantile_cont(latency, 0.95) as p95 from z group by all), l as (select key, quantile_cont(p95, 0.9) as lim from m where epoch < 10 group by key)
select m.key, epoch, round(p95, 6) as p95, cast(p95 > lim as bigint) as severe from m join l on m.key = l.key""")
def severe_epochs(spark, sf_dir):
    m = policy.run_metrics(_latencies(spark, sf_dir), ["key", "epoch"], 12.0).select("key", "epoch", "p95")
    return policy.severe_epochs(m, ["key"], F.col("epoch") < 10)


_GRID_VALUES = ", ".join(f"{q}::double" for q in policy.GRID)


@query(E_P + f""", tr as (select panel, p, target from p where split = 'train'), c as (select distinct panel, unnest(qs) as threshold from (select panel, quantile_cont(p, [{_GRID_VALUES}]) as qs from tr group by panel)),
r as (select c.panel, threshold, avg(target * (1 - cast(p >= threshold as int))) as miss, avg(cast(p >= threshold as int)) as action_rate from tr join c on tr.panel = c.panel group by all),
k as (select *, 10 * miss + action_rate as cost from r) select panel, round(threshold, 6) as threshold, round(cost, 6) as cost, round(action_rate, 6) as action_rate
from (select *, row_number() over (partition by panel order by round(cost / 1e-9), action_rate, threshold desc) as b from k) where b = 1""")
def threshold_search(spark, sf_dir):
    return policy.search_threshold(event_scored(spark, sf_dir).where("split = 'train'"), ["panel"], 10.0)


#: Epochs with the number of each key's training epochs; policies with their action's delay.
_TRAINED = _SLOTS + f", t as (select *, cast(floor({policy.TRAIN_SHARE} * count(*) over (partition by key)) as bigint) as train from e)"
_POLICIES = {"no_action": "0", "always_on": "1", "reactive": "coalesce(lag(event, 1 + {d}) over (partition by key order by epoch), 0)"}
_ACTS = ", d as (" + " union all ".join(
    f"select key, epoch, event, train, '{p}' as policy, {d} as delay, {x.format(d=d)} as act from t" for p, x in _POLICIES.items() for d in (0, 1, 2)) + ")"
#: Requests of an epoch stand at the beginning of their slots; one service time, so servers take turns.
_BOTH = f""", a as (select key, epoch, slot * cast({policy.SLOT_MS} as double) as a, j from s0, range(9) g(j) where j < n),
k as (select *, row_number() over (partition by key, epoch order by a, j) - 1 as k from a),
z as (select key, epoch, {", ".join(f"cast({policy.SERVICE_MS} as double) * (floor(k / {w}) + 1) + max(a - cast({policy.SERVICE_MS} as double) * floor(k / {w})) over (partition by key, epoch, k % {w} order by k) - a as l{w}" for w in (policy.LOW_WORKERS, policy.HIGH_WORKERS))} from k),
m as (select d.*, case when act = 1 then l{policy.HIGH_WORKERS} else l{policy.LOW_WORKERS} end as latency from d join z using (key, epoch) where epoch >= train),
o as (select policy, delay, key, count(*) as requests, quantile_cont(latency, 0.5) as p50, quantile_cont(latency, 0.95) as p95, quantile_cont(latency, 0.99) as p99, avg(cast(latency > {policy.SLA_MS} as int)) as sla_violations from m group by all),
pe as (select policy, delay, key, epoch, quantile_cont(latency, 0.95) as p95 from m group by all),
ee as (select policy, delay, d.key, count(*) as epochs, avg(coalesce(p95, 0)) as mean_epoch_p95, cast(avg(act) as double) as scale_share, cast(sum(event * act) as double) / greatest(sum(event), 1) as coverage,
  avg(event * (1 - act)) as missed, cast(sum(case when act = 1 then {policy.HIGH_WORKERS} else {policy.LOW_WORKERS} end) as bigint) as worker_epochs
  from d left join pe using (policy, delay, key, epoch) where d.epoch >= train group by all),
runs as (select ee.*, requests, p50, o.p95, p99, sla_violations from ee left join o using (policy, delay, key))"""


def _trained(spark, sf_dir):
    train = F.floor(d(policy.TRAIN_SHARE) * F.count("*").over(W.partitionBy("key"))).cast("long")
    return _epochs(spark, sf_dir).withColumn("train", train)


def _runs(spark, sf_dir):
    t = _trained(spark, sf_dir)
    decided = t.withColumns(policy.simple_decisions(["key"]))
    order = W.partitionBy("key").orderBy("epoch")
    acts = [
        F.struct(F.lit(p).alias("policy"), F.lit(k).alias("delay"), (F.col(p) if p != "reactive" else F.coalesce(F.lag("event", 1 + k).over(order), F.lit(0))).cast("long").alias("act"))
        for p in _POLICIES for k in (0, 1, 2)
    ]
    decided = decided.select("key", "epoch", "event", "train", F.array(*acts).alias("acts")).where("epoch >= train")
    decided = decided.select("key", "epoch", "event", F.explode("acts").alias("x")).select("key", "epoch", "event", "x.*")
    s = _slots(spark, sf_dir).where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    a = s.select("key", "epoch", "j", (F.col("slot") * d(policy.SLOT_MS)).alias("a"))
    k = a.withColumn("k", (F.row_number().over(W.partitionBy("key", "epoch").orderBy("a", "j")) - 1).cast("long"))
    return policy.simulate(k, decided, ["key"], ["policy", "delay"])


_RUN = ["p50", "p95", "p99", "sla_violations", "mean_epoch_p95", "scale_share", "coverage", "missed"]


@query(_TRAINED + _ACTS + _BOTH + " select policy, delay, key, epochs, requests, worker_epochs, " + ", ".join(f"round({c}, 6) as {c}" for c in _RUN) + " from runs")
def policy_latency(spark, sf_dir):
    """Decision, workers, queue and what requests meet, per policy, delay and schedule."""
    return _runs(spark, sf_dir).select("policy", "delay", "key", "epochs", "requests", "worker_epochs", *_RUN)


_BOOT = ["p95", "sla_violations", "scale_share", "coverage", "worker_epochs"]


@query(_TRAINED + _ACTS + _BOTH + """, lr as (select policy, delay, row_number() over (partition by policy, delay order by key) - 1 as pick, count(*) over (partition by policy, delay) as seeds, """
       + ", ".join(f"cast({c} as double) as {c}" for c in _BOOT) + " from runs where p95 is not null), ll as (unpivot lr on " + ", ".join(_BOOT) + """ into name metric value v),
sd as (select distinct policy, delay, seeds from lr), dw as (select policy, delay, rep, """ + DRAW.format(a="rep", b="k", n="seeds") + """ as pick from sd, range(200) a(rep), range(200) b(k) where k < seeds),
rr as (select ll.policy, ll.delay, metric, seeds, rep, avg(v) as v from dw join ll on dw.policy = ll.policy and dw.delay = ll.delay and dw.pick = ll.pick group by all)
select policy, delay, metric, seeds, round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from rr group by all""")
def seed_bootstrap(spark, sf_dir):
    """Schedules resampled within each policy and delay."""
    return bootstrap.seed_means(_runs(spark, sf_dir).where("p95 is not null"), "key", ["policy", "delay"], _BOOT, 200)


def _search_sql(kind: str, delay: int) -> str:
    h = 1 + delay
    on = "cast(p >= threshold as int)" if kind == "predictive" else "cast(coalesce(hi > coalesce(pa, -1), false) as int)"
    return f"""select key, '{kind}' as kind, {delay} as delay, threshold, cost, action_rate from (select *, row_number() over (partition by key order by round(cost / 1e-9), action_rate, threshold) as b from (
 select key, threshold, 10 * avg(event * (1 - act)) + avg(act) as cost, avg(act) as action_rate from (
 select *, lag(dec, {h}, 0) over (partition by key, threshold order by epoch) as act from (select *, {on} as dec from (
 select *, max(case when high then epoch end) over (partition by key, threshold order by epoch) as hi, max(case when low and coalesce(plow, false) then epoch end) over (partition by key, threshold order by epoch) as pa from (
 select *, lag(low) over (partition by key, threshold order by epoch) as plow from (
 select *, p >= threshold or event = 1 as high, not (p >= threshold or event = 1) and p < {policy.LOW_FACTOR} * threshold as low from (
 select s.*, threshold from s join (select distinct key, unnest(list_concat([cast(0 as double)], coalesce(quantile_cont(p, [{_GRID_VALUES}]) filter (where epoch < train - {h}), []), [cast(1 as double)])) as threshold
   from s where train > {h} group by key) c on s.key = c.key where train > {h})))))) where epoch >= {h} group by key, threshold)) where b = 1"""


_KINDS = [(kind, delay) for kind in ("predictive", "hybrid") for delay in (0, 1, 2)]


@query(_TRAINED + ", s as (select key, epoch, event, train, (cnt + cast(0.5 as double)) / 13.0 as p from t where epoch < train), f as (" + " union all ".join(_search_sql(*x) for x in _KINDS)
       + ") select key, kind, delay, round(threshold, 6) as threshold, round(cost, 6) as cost, round(action_rate, 6) as action_rate from f")
def threshold_search_delayed(spark, sf_dir):
    """The least-cost threshold of a closed-form score, by kind of policy and by the delay of its actions."""
    t = _trained(spark, sf_dir).select("key", "epoch", F.col("event").alias("target"), "train", ((F.col("cnt") + d(0.5)) / d(13)).alias("p"))
    # Written, as is each search's result: else the union's task would hold what all six need.
    t = written(t, "epochs")
    out = None
    for kind, delay in _KINDS:
        found = written(policy.search_delayed(t, ["key"], 1 + delay, 10.0, kind), "search").withColumns({"kind": F.lit(kind), "delay": F.lit(delay)})
        out = found if out is None else out.unionByName(found)
    return out.select("key", "kind", "delay", "threshold", "cost", "action_rate")
