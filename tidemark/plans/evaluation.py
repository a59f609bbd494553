"""Queries on splits, features, models, scores and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import clip, core_feature, d, logit, smoothed_rate
from ..operators import boosting, bootstrap, features, metrics, models, windows
from ..operators.scratch import written
from . import newton_sql
from .adapters import DRAW, E_P, E_T, L_W, K, core_blocks, event_blocks, event_scored, event_split, resource_blocks, rounded, table

QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = ((lambda spark, sf_dir: rounded(f(spark, sf_dir))), sql)
        return f

    return add


def _test(spark, sf_dir):
    return event_scored(spark, sf_dir).where("split = 'test'")


@query(E_T + " select panel, split, count(*) as rows, cast(sum(target) as bigint) as positives, min(window_id) as first, max(window_id) as last from t group by all")
def temporal_split(spark, sf_dir):
    return event_split(spark, sf_dir).groupBy("panel", "split").agg(F.count("*").alias("rows"), F.sum("target").alias("positives"), F.min("window_id").alias("first"), F.max("window_id").alias("last"))


@query(E_T + """, a as (select *, row_number() over (partition by panel order by window_id) - 1 as k, count(*) over (partition by panel) as nt from o where nxt = window_id + 1)
select panel, cast(count(*) filter (where k < greatest(20, floor(cast(0.7 as double) * nt))) as bigint) as train, cast(count(*) filter (where k >= greatest(20, floor(cast(0.7 as double) * nt))) as bigint) as test from a group by panel""")
def ordered_split(spark, sf_dir):
    t = features.ordered_split(features.transitions(event_blocks(spark, sf_dir), ["panel"]), ["panel"])
    return t.groupBy("panel").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


@query("select case when ('0x' || substr(md5(cast(s_suppkey as varchar)), 1, 8))::bigint % 1000 < 700 then 'train' else 'test' end as split, count(*) as entities, cast(sum(s_suppkey) as bigint) as checksum from supplier group by 1")
def panel_disjoint(spark, sf_dir):
    s = features.disjoint_split(table(spark, sf_dir, "supplier"), "s_suppkey")
    return s.groupBy("split").agg(F.count("*").alias("entities"), F.sum("s_suppkey").alias("checksum"))


#: The seed of the entities' shuffle.
_SHUFFLE = 17
_SHUFFLED = "(select {e}, case when row_number() over (order by md5('" + str(_SHUFFLE) + "-' || cast({e} as varchar)), {e}) - 1 < floor(0.7::double * count(*) over ()) then 'train' else 'test' end as split from (select distinct {e} from {t} where {e} is not null))"


@query("select split, count(*) as entities, cast(sum(s_suppkey) as bigint) as checksum from " + _SHUFFLED.format(e="s_suppkey", t="supplier") + " group by split")
def panel_disjoint_exact(spark, sf_dir):
    """Disjoint sets of exact size."""
    s = features.exact_split(table(spark, sf_dir, "supplier"), "s_suppkey", _SHUFFLE)
    return s.groupBy("split").agg(F.count("*").alias("entities"), F.sum("s_suppkey").alias("checksum"))


_LATE = "(cast(snapshot >= 1 as int) + cast(snapshot_late >= 1 as int))"
_PAIR = ["snapshot", "snapshot_late", "greatest(snapshot, snapshot_late)", f"{_LATE} / 2.0"]
_COUNT, _TOP = "cnt / 12.0", "cast(maximum >= 1 as int)"
_flagged = lambda v: [v, f"cast({v} >= 1 as int)"]
#: Columns of every scheme in SQL, by family. The first of a family keeps the family's name as its query's.
_FEATURES = {
    "offset": {
        "two_snapshots": [*_PAIR, f"cast({_LATE} > 0 as int)"], "snapshot": _flagged("snapshot"), "mean": _flagged("mean"), "p95": _flagged("p95"),
        "maximum": _flagged("maximum"), "maximum_count": ["maximum", _COUNT, _TOP],
    },
    "multi": {
        "maximum_count": ["maximum", _COUNT, _TOP], "persistence": ["event"], "snapshot": _flagged("snapshot"), "two_snapshots": _PAIR,
        "maximum": ["maximum"], "count": [_COUNT],
    },
    "ablation": {
        "full": ["maximum", _COUNT, _TOP], "persistence": ["event"], "snapshot": ["snapshot"], "two_snapshots": _PAIR[:2], "maximum": ["maximum"],
        "count": [_COUNT], "maximum_event": ["maximum", _TOP], "maximum_count": ["maximum", _COUNT],
    },
    "external": {
        "snapshot": _flagged("snapshot"), "prior": [], "persistence": ["event"], "two_snapshots": _PAIR, "maximum": ["maximum"], "count": [_COUNT],
        "maximum_count": ["maximum", _COUNT], "full": ["maximum", _COUNT, _TOP],
    },
}


def _feature_query(family: str, scheme: str, sql: list[str], name: str) -> None:
    text = "".join(f", round(cast({x} as double), 6) as f{i}" for i, x in enumerate(sql))

    def run(spark, sf_dir):
        return event_split(spark, sf_dir).select("panel", "window_id", "target", *features.features(family, scheme))

    run.__name__ = name
    query(E_T + f" select panel, window_id, target{text} from t")(run)


for _family, _schemes in _FEATURES.items():
    for _n, (_scheme, _sql) in enumerate(_schemes.items()):
        _feature_query(_family, _scheme, _sql, f"features_{_family}_{_scheme}" if _n else f"features_{_family}")


@query(E_T + ", k as (select panel, cast(sum(target) as bigint) as k, count(*) as n from t where split = 'train' group by panel) select panel, k, n, round((k + 0.5::double) / (n + 1), 6) as rate from k")
def priors(spark, sf_dir):
    return features.priors(event_split(spark, sf_dir), ["panel"])


@query(E_T + """, g as (select avg(maximum) filter (where split = 'train') as a, stddev_pop(maximum) filter (where split = 'train') as s from t)
select panel, window_id, round((maximum - a) / case when s < 1e-8 then 1 else s end, 6) as maximum from t, g""")
def standardise(spark, sf_dir):
    return features.standardise(event_split(spark, sf_dir), ["maximum"]).select("panel", "window_id", "maximum")


@query(E_T + " select round(quantile_cont(maximum, 0.95), 6) as threshold from t")
def leaky_threshold(spark, sf_dir):
    return features.leaky_snapshot_threshold(event_split(spark, sf_dir))


_T = E_P + ", y as (select * from p where split = 'test')"
_AP = "select {k} sum(k * tp / nn::double) / nullif(sum(k), 0) as v from (select *, sum(k) over ({w} order by p desc) as tp, sum(n) over ({w} order by p desc) as nn from (select {k} p, count(*) as n, sum(target) as k from {t} group by {k} p)) {g}"


@query(_T + ", a as (" + _AP.format(k="panel,", w="partition by panel", t="y", g="group by panel") + ") select panel, round(v, 6) as average_precision from a")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_test(spark, sf_dir), ["panel"])


@query(_T + """, r as (select panel, target, sum(target) over (partition by panel order by p desc, window_id rows unbounded preceding) as tp, row_number() over (partition by panel order by p desc, window_id) as n from y)
select panel, round(avg(case when target = 1 then tp / n::double end), 6) as average_precision_stable from r group by panel""")
def average_precision_stable(spark, sf_dir):
    return metrics.average_precision_stable(_test(spark, sf_dir), ["panel"], ["window_id"])


@query(_T + """, r as (select *, rank() over (partition by panel order by p) + (count(*) over (partition by panel, p) - 1) / 2.0 as rk from y),
g as (select panel, sum(case when target = 1 then rk end) as s, cast(sum(target) as double) as k, count(*) - sum(target)::double as m from r group by panel)
select panel, round((s - k * (k + 1) / 2) / nullif(k * m, 0), 6) as roc_auc from g""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_test(spark, sf_dir), ["panel"])


@query(_T + """ select panel, count(*) as rows, cast(sum(target) as bigint) as positives, round(avg(target), 6) as prevalence, round(avg((target - p) * (target - p)), 6) as brier,
round(avg(target * ln(p) + (1 - target) * ln(1 - p)), 6) as mean_log_score from y group by panel""")
def brier_log_score(spark, sf_dir):
    return metrics.point_scores(_test(spark, sf_dir), ["panel"])


@query(_T + """, b as (select panel, count(*) as n, abs(avg(p) - avg(target)) as gap from y group by panel, """ + " + ".join(f"cast(p > {i / 10}::double as int)" for i in range(1, 10)) + """)
select panel, round(sum(n * gap) / sum(n), 6) as ece_10 from b group by panel""")
def ece_10(spark, sf_dir):
    return metrics.calibration_error(_test(spark, sf_dir), ["panel"])


@query(_T + ", b as (select *, ntile(10) over (partition by panel order by p, window_id) as bin from y) select panel, bin, count(*) as rows, round(avg(p), 6) as mean_p, round(avg(target), 6) as observed from b group by all")
def reliability_bins(spark, sf_dir):
    return metrics.reliability_bins(_test(spark, sf_dir), ["panel"], ["window_id"])


@query(_T + """, r as (select *, row_number() over (partition by panel order by p desc, window_id) as rk, count(*) over (partition by panel) as n from y),
g as (select panel, cast(count(*) filter (where rk <= ceil(0.05::double * n)) as bigint) as alerts, sum(target) filter (where rk <= ceil(0.05::double * n)) as tp, sum(target) as k from r group by panel)
select panel, alerts, round(tp / nullif(k, 0)::double, 6) as alert_recall, round(tp / alerts::double, 6) as alert_precision from g""")
def alert_topk(spark, sf_dir):
    return metrics.alerts(_test(spark, sf_dir), ["panel"], ["window_id"], 0.05)


@query(_T + " select panel, window_id, round(p, 6) as p from y order by p desc, panel, window_id limit 25")
def best_budget(spark, sf_dir):
    return metrics.best_budget(_test(spark, sf_dir), 25, ["panel", "window_id"]).select("panel", "window_id", "p")


#: The other score of comparisons: a panel's smoothed training rate.
_TWO = E_P + """, kk as (select panel, (sum(target) + 0.5::double) / (count(*) + 1) as prior from t where split = 'train' group by panel),
y as (select p.*, prior from p join kk on p.panel = kk.panel where split = 'test')"""


def _two(spark, sf_dir):
    return features.with_prior(event_scored(spark, sf_dir), ["panel"]).where("split = 'test'")


_GAIN = ", g as (select panel, cast(sum(target) as bigint) as positives, avg(target * ln(p) + (1 - target) * ln(1 - p)) - avg(target * ln(prior) + (1 - target) * ln(1 - prior)) as gain from y group by panel)"


@query(_TWO + _GAIN + " select panel, positives, round(gain, 6) as gain from g")
def per_panel_gain(spark, sf_dir):
    return metrics.entity_gain(_two(spark, sf_dir), "panel", "prior", "p")


@query(_TWO + _GAIN + " select count(*) as entities, cast(count(*) filter (where gain > 0) as bigint) as wins, round(quantile_cont(gain, 0.5), 6) as median_gain from g where positives > 0")
def gain_summary(spark, sf_dir):
    return metrics.gain_summary(metrics.entity_gain(_two(spark, sf_dir), "panel", "prior", "p"))


@query(_TWO + _GAIN + """, sg as (select cast(count(*) filter (where gain > 0) as bigint) as wins, count(*) as entities from g where positives > 0),
tg as (select wins, entities, i from sg, range(1000) r(i) where i <= least(wins, entities - wins))
select wins, entities, round(least(1, 2 * sum(exp(lgamma(entities + 1) - lgamma(i + 1) - lgamma(entities - i + 1) - entities * ln(cast(2 as double))))), 6) as p_value from tg group by all""")
def sign_test(spark, sf_dir):
    g = metrics.gain_summary(metrics.entity_gain(_two(spark, sf_dir), "panel", "prior", "p")).first()
    return spark.createDataFrame([(g.wins, g.entities, metrics.sign_test(g.wins, g.entities))], "wins long, entities long, p_value double")


_REPS = 200
_DRAWS = ", dr as (select rep, " + DRAW.format(a="rep", b="k", n="{n}") + " as pick from range({reps}) a(rep), range({n}) b(k))"
_CI = "round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high"


@query(_TWO + ", c as (select row_number() over (order by panel) - 1 as pick, sum((target - prior) * (target - prior) - (target - p) * (target - p)) as s, count(*) as n from y group by panel)"
       + _DRAWS.format(n="(select count(*) from c)", reps=_REPS) + f", r as (select rep, sum(s) / sum(n) as v from dr join c on dr.pick = c.pick group by rep) select {_CI} from r")
def cluster_bootstrap(spark, sf_dir):
    gain = F.pow(F.col("target") - F.col("prior"), 2) - F.pow(F.col("target") - F.col("p"), 2)
    c = _two(spark, sf_dir).groupBy("panel").agg(F.sum(gain).alias("s"), F.count("*").alias("n"))
    return bootstrap.cluster_ratio(c, "panel", "s", "n", _REPS)


@query(_TWO + ", c as (select row_number() over (order by panel) - 1 as pick, avg((target - prior) * (target - prior) - (target - p) * (target - p)) as s from y group by panel)"
       + _DRAWS.format(n="(select count(*) from c)", reps=_REPS) + f", r as (select rep, avg(s) as v from dr join c on dr.pick = c.pick group by rep) select {_CI} from r")
def cluster_mean_bootstrap(spark, sf_dir):
    gain = F.pow(F.col("target") - F.col("prior"), 2) - F.pow(F.col("target") - F.col("p"), 2)
    c = _two(spark, sf_dir).groupBy("panel").agg(F.avg(gain).alias("s"))
    return bootstrap.cluster_mean(c, "panel", "s", _REPS)


@query(_TWO + ", c as (select panel, row_number() over (order by panel) - 1 as pick from (select distinct panel from y))" + _DRAWS.format(n="(select count(*) from c)", reps=50)
       + ", m as (select rep, p, target from dr join c on dr.pick = c.pick join y on y.panel = c.panel), a as (" + _AP.format(k="rep,", w="partition by rep", t="m", g="group by rep") + f") select {_CI} from a")
def pooled_precision_bootstrap(spark, sf_dir):
    return bootstrap.pooled_precision(_two(spark, sf_dir), "panel", 50)


@query(_TWO.replace("prior from p join", "0.02 + 0.9 * (window_id % 7) / 7.0 as other, prior from p join") + ", e as (select panel from y group by panel having min(target) <> max(target)), q as (select y.* from y join e on y.panel = e.panel), l as ("
       + _AP.format(k="panel,", w="partition by panel", t="(select panel, other as p, target from q)", g="group by panel") + "), h as (" + _AP.format(k="panel,", w="partition by panel", t="q", g="group by panel")
       + "), c as (select row_number() over (order by l.panel) - 1 as pick, h.v - l.v as s from l join h on l.panel = h.panel)" + _DRAWS.format(n="(select count(*) from c)", reps=_REPS)
       + f", r as (select rep, avg(s) as v from dr join c on dr.pick = c.pick group by rep) select {_CI} from r")
def precision_gain_bootstrap(spark, sf_dir):
    t = _two(spark, sf_dir).withColumn("other", d(0.02) + d(0.9) * (F.col("window_id") % 7) / d(7))
    return bootstrap.precision_gain(t, "panel", "other", "p", _REPS)


_ONE = ", z as (select *, row_number() over (partition by panel order by window_id) - 1 as at from y), nz as (select panel, count(*) as n from z group by panel)"
_BLOCKS = (", st as (select panel, rep, n, unnest(range(cast(ceil(n / 12.0) as bigint))) as k from range(100) a(rep), nz),"
           " st2 as (select panel, rep, k, n, " + DRAW.format(a="rep", b="k", n="n") + " as start from st), bl as (select panel, rep, (start + j) % n as at from st2, range(12) c(j) where k * 12 + j < n)")


@query(_TWO + _ONE + _BLOCKS + f", r as (select bl.panel, rep, sum(case when event = 1 and snapshot >= 1 then 1.0 else 0 end) / nullif(sum(event), 0) as v from bl join z on bl.at = z.at and bl.panel = z.panel group by all) select panel, {_CI} from r group by panel")
def moving_block_recall(spark, sf_dir):
    return bootstrap.block_recall(_two(spark, sf_dir), "panel", "window_id", F.col("snapshot") >= 1, "event", 100)


@query(_TWO + _ONE + _BLOCKS + ", m as (select bl.panel, rep, p, prior, target from bl join z on bl.at = z.at and bl.panel = z.panel), h as (" + _AP.format(k="panel, rep,", w="partition by panel, rep", t="m", g="group by panel, rep") + "), l as ("
       + _AP.format(k="panel, rep,", w="partition by panel, rep", t="(select panel, rep, prior as p, target from m)", g="group by panel, rep") + f"), r as (select h.panel, h.v - l.v as v from h join l on h.rep = l.rep and h.panel = l.panel) select panel, {_CI} from r group by panel")
def moving_block_precision(spark, sf_dir):
    return bootstrap.block_precision_gain(_two(spark, sf_dir), "panel", "window_id", "prior", "p", 100)


def _fit_frame(spark, sf_dir, scheme="maximum_count", family="multi"):
    f = features.features(family, scheme)
    t = features.with_prior(event_split(spark, sf_dir), ["panel"])
    names = [f"f{i}" for i in range(len(f))]
    return t.select("panel", "window_id", "split", "target", logit(clip("prior", 1e-6, 1 - 1e-6)).alias("offset"), *f), names


_OFFSET_X = _FEATURES["offset"]["maximum_count"]


@query(E_T + """, kk as (select panel, (sum(target) + 0.5::double) / (count(*) + 1) as prior from t where split = 'train' group by panel),
sa as (select t.panel, split, target, cast(target as double) as y, ln(prior / (1 - prior)) as o""" + newton_sql.scaled_by(_OFFSET_X, "split = 'train'") + """ from t join kk on t.panel = kk.panel),
sr as (select * from sa where split = 'train')""" + newton_sql.fit("fit", "sr", 3, offset=True) + f""", y as (select target, 1 / (1 + exp(-({newton_sql.linear(3, True)}))) as p from sa join fit on true where split = 'test'),
ap as (""" + _AP.format(k="", w="", t="y", g="") + """) select count(*) as rows, cast(sum(target) as bigint) as positives, round(avg(target), 6) as prevalence, round(avg((target - p) * (target - p)), 6) as brier,
round(avg(target * ln(p) + (1 - target) * ln(1 - p)), 6) as mean_log_score, round(max(v), 6) as average_precision from y, ap""")
def offset_logistic(spark, sf_dir):
    t, names = _fit_frame(spark, sf_dir, "maximum_count", "offset")
    m = models.fit_logistic(t.where("split = 'train'"), names, offset="offset")
    scored = t.where("split = 'test'").withColumn("p", m.score(names, F.col("offset")))
    return metrics.point_scores(scored, []).join(F.broadcast(metrics.average_precision(scored, [])))


_COEFFICIENTS = {s: _FEATURES["multi"][s] for s in ("persistence", "snapshot", "maximum", "maximum_count")}


@query(E_T + ", tt as (select * from t where split = 'train')" + "".join(
    f", s_{s} as (select cast(target as double) as y{newton_sql.scaled(x)} from tt)" + newton_sql.fit(f"f_{s}", f"s_{s}", len(x)) for s, x in _COEFFICIENTS.items())
    + " " + " union all ".join(f"select '{s}' as scheme, {i} as term, round(b{i}, 6) as value from f_{s}" for s, x in _COEFFICIENTS.items() for i in range(len(x) + 1)))
def logistic_coefficients(spark, sf_dir):
    """(scheme, term, value): term 0 is the intercept."""
    rows = []
    for scheme in _COEFFICIENTS:
        t, names = _fit_frame(spark, sf_dir, scheme)
        rows.append(models.fit_logistic(t.where("split = 'train'"), names).row(scheme=scheme))
    t = models.coefficient_table(spark, rows)
    return t.select("scheme", F.posexplode(F.concat(F.array("intercept"), "values")).alias("term", "value"))


_DISJOINT = {k: [c.replace(">= 1", ">= 50") for c in _FEATURES["offset"][k]] + ["log2(greatest(cores, 1))"] for k in ("snapshot", "maximum", "two_snapshots", "maximum_count")}
_BY_USER = """with s as (select user_id as panel, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as x, cast(1 + event_id % 8 as double) as cores from events),
wp as (select *, cast(floor(i / 12.0) as bigint) as window_id, i % 12 as pos from s),
w as (select panel, window_id, max(case when pos = 0 then x end) as snapshot, max(case when pos = 6 then x end) as snapshot_late, max(x) as maximum,
  cast(count(*) filter (where x >= 50) as bigint) as cnt, cast(max(case when x >= 50 then 1 else 0 end) as bigint) as event, quantile_cont(cores, 0.5) as cores from wp group by panel, window_id having count(*) = 12),
t0 as (select w.*, n.event as target from w join w as n on n.panel = w.panel and n.window_id = w.window_id + 1),
t as (select t0.*, split from t0 join """ + _SHUFFLED.format(e="panel", t="t0") + """ as sh using (panel)),
pr as (select (sum(target) + 0.5::double) / (count(*) + 1) as r from t where split = 'train')"""


def _disjoint_sql(scheme: str, x: list[str]) -> str:
    return (f", sa_{scheme} as (select split, target, cast(target as double) as y, ln(r / (1 - r)) as o" + newton_sql.scaled_by(x, "split = 'train'") + f" from t, pr), sr_{scheme} as (select * from sa_{scheme} where split = 'train')"
            + newton_sql.fit(f"f_{scheme}", f"sr_{scheme}", len(x), offset=True)
            + f", y_{scheme} as (select target, 1 / (1 + exp(-({newton_sql.linear(len(x), True)}))) as p from sa_{scheme} join f_{scheme} on true where split = 'test'), ap_{scheme} as (" + _AP.format(k="", w="", t=f"y_{scheme}", g="") + ")")


#: Schemes whose fit SQL can follow: a factor of more columns, written out, outgrows it.
_FEW = ("snapshot", "maximum")


@query(_BY_USER + "".join(_disjoint_sql(k, _DISJOINT[k]) for k in _FEW) + " " + " union all ".join(
    f"select '{k}' as scheme, count(*) as rows, cast(sum(target) as bigint) as positives, round(avg(target), 6) as prevalence, round(avg((target - p) * (target - p)), 6) as brier, round(avg(target * ln(p) + (1 - target) * ln(1 - p)), 6) as mean_log_score, round(max(v), 6) as average_precision from y_{k}, ap_{k}"
    for k in _FEW))
def panel_disjoint_pair(spark, sf_dir):
    """panel_disjoint_forecast() of two schemes."""
    return _disjoint(spark, sf_dir, _FEW)


@query(None)
def panel_disjoint_forecast(spark, sf_dir):
    """Entities of the test share are never trained on; every scheme has the size as a further feature."""
    return _disjoint(spark, sf_dir, tuple(_DISJOINT))


def _disjoint(spark, sf_dir, schemes):
    pairs = windows.contiguous(core_blocks(spark, sf_dir), ["panel"], ["event"]).withColumnRenamed("next_event", "target")
    pairs = written(pairs, "pairs")
    t = pairs.join(features.exact_split(pairs, "panel", _SHUFFLE), "panel")
    rate = t.where("split = 'train'").agg(logit(smoothed_rate(F.sum("target"), F.count("*"))).alias("offset"))
    t, out = written(t.join(F.broadcast(rate)), "transitions"), None  # one row
    for scheme in schemes:
        f = [*features.features("offset", scheme, 50.0), core_feature("cores").alias("size")]
        s = t.select("split", "target", "offset", *f)
        names = [c for c in s.columns if c not in ("split", "target", "offset")]
        m = models.fit_logistic(s.where("split = 'train'"), names, offset="offset")
        scored = s.where("split = 'test'").withColumn("p", m.score(names, F.col("offset"))).withColumn("scheme", F.lit(scheme))
        row = metrics.point_scores(scored, ["scheme"]).join(metrics.average_precision(scored, ["scheme"]), "scheme")
        out = row if out is None else out.unionByName(row)
    return out


_RESOURCE_X = _FEATURES["multi"]["maximum_count"]
#: The same transitions of the orders, by priority.
_ORDERS_T = E_T.replace("event_type", "o_orderpriority").replace("ts, event_id", "o_orderdate, o_orderkey").replace("value as raw", "o_totalprice as raw").replace("from events", "from orders")
_MOVED = ", ".join(f"avg(cast({c} as double)) as m{i + 1}, case when coalesce(stddev_pop(cast({c} as double)), 0) = 0 then 1 else stddev_pop(cast({c} as double)) end as v{i + 1}" for i, c in enumerate(_RESOURCE_X))
_BINS = " + ".join(f"cast(p > {i / 10}::double as int)" for i in range(1, 10))


@query(E_T + ", tt as (select * from t where split = 'train'), sr as (select cast(target as double) as y" + newton_sql.scaled(_RESOURCE_X) + " from tt)" + newton_sql.fit("fit", "sr", 3)
       + f", sc as (select {_MOVED} from tt), oth as ({_ORDERS_T} select * from t where split = 'test'), xs as (select panel, target, "
       + ", ".join(f"(cast({c} as double) - m{i + 1}) / v{i + 1} as x{i + 1}" for i, c in enumerate(_RESOURCE_X))
       + f" from oth, sc), y as (select panel, target, 1 / (1 + exp(-({newton_sql.linear(3, False)}))) as p from xs join fit on true), ap as (" + _AP.format(k="panel,", w="partition by panel", t="y", g="group by panel")
       + f"""), rk as (select *, rank() over (partition by panel order by p) + (count(*) over (partition by panel, p) - 1) / 2.0 as r from y),
au as (select panel, (sum(case when target = 1 then r end) - sum(target) * (sum(target) + 1) / 2.0) / nullif(sum(target) * (count(*) - sum(target)), 0) as roc_auc from rk group by panel),
be as (select panel, count(*) as n, abs(avg(p) - avg(target)) as gap from y group by panel, {_BINS}), ec as (select panel, sum(n * gap) / sum(n) as ece_10 from be group by panel),
ps as (select panel, count(*) as rows, cast(sum(target) as bigint) as positives, avg(target) as prevalence, avg((target - p) * (target - p)) as brier, avg(target * ln(p) + (1 - target) * ln(1 - p)) as mls from y group by panel)
select panel, rows, positives, round(prevalence, 6) as prevalence, round(brier, 6) as brier, round(mls, 6) as mean_log_score, round(v, 6) as average_precision, round(cast(roc_auc as double), 6) as roc_auc, round(ece_10, 6) as ece_10
from ps join ap using (panel) join au using (panel) join ec using (panel)""")
def frozen_transfer(spark, sf_dir):
    """Fitted on the events' panels, scored on the orders' without any refit."""
    from ..operators import clean

    t, names = _fit_frame(spark, sf_dir)
    m = models.fit_mean_loss(t.where("split = 'train'"), names)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("panel"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("x"))
    o = clean.normalise_bursts(clean.in_order(o, ["panel"], ["o_orderdate", "o_orderkey"], keep=True), ["panel"])
    blocks = windows.summarise(windows.positional(o, K), ["panel"], K)
    other = features.temporal_split(blocks, ["panel"]).where("split = 'test'").select("panel", "target", *features.features("multi", "maximum_count"))
    scored = other.withColumn("p", m.score(names))
    out = metrics.point_scores(scored, ["panel"])
    for more in (metrics.average_precision, metrics.roc_auc, metrics.calibration_error):
        out = out.join(more(scored, ["panel"]), "panel")
    return out


def _newton_sql(steps: int = 12) -> str:
    """Newton's steps for intercept a and slope b of the target's logit on the score's, a table each."""
    out = ", z as (select target, ln(greatest(least(p, 1 - 1e-8), 1e-8) / (1 - greatest(least(p, 1 - 1e-8), 1e-8))) as z from y), n0 as (select cast(0 as double) as a, cast(0 as double) as b)"
    for i in range(steps):
        out += f""", g{i} as (select n.a, n.b, sum(target - q) as ga, sum((target - q) * z) as gb, sum(q * (1 - q)) as haa, sum(q * (1 - q) * z) as hab, sum(q * (1 - q) * z * z) as hbb
 from (select n0.*, z.*, 1 / (1 + exp(-(n0.a + n0.b * z.z))) as q from z, n{i} as n0) as n group by all),
n{i + 1} as (select a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) as b from g{i})"""
    return out + f" select round(a, 6) as intercept, round(b, 6) as slope from n{steps}"


@query(_T + _newton_sql())
def calibration_line(spark, sf_dir):
    a, b = models.calibration_line(_test(spark, sf_dir))
    return spark.createDataFrame([(a, b)], "intercept double, slope double")


#: Clipping bounds of the fits' variants: fixed values.
_BOUNDS = {"eight": 1e-8, "six": 1e-6, "machine": 2.220446049250313e-16}


def _line_sql(name: str, score: str, eps: float, steps: int = 12) -> str:
    """Newton's steps from (0, 1) where the classes' scores overlap on both sides, no row else."""
    q = f"greatest(least({score}, 1 - cast({eps!r} as double)), cast({eps!r} as double))"
    out = f", z_{name} as (select target, ln({q} / (1 - {q})) as z from y), ok_{name} as (select max(z) filter (where target = 0) > min(z) filter (where target = 1) and max(z) filter (where target = 1) > min(z) filter (where target = 0) as ok from z_{name})"
    out += f", n_{name}0 as (select cast(0 as double) as a, cast(1 as double) as b from ok_{name} where ok)"
    for i in range(steps):
        out += f""", g_{name}{i} as (select a, b, sum(target - q) as ga, sum((target - q) * z) as gb, sum(q * (1 - q)) as haa, sum(q * (1 - q) * z) as hab, sum(q * (1 - q) * z * z) as hbb
 from (select n0.*, z.*, 1 / (1 + exp(-(n0.a + n0.b * z.z))) as q from z_{name} as z, n_{name}{i} as n0) group by all),
n_{name}{i + 1} as (select a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) as b from g_{name}{i})"""
    return out + f", r_{name} as (select '{name}' as variant, round(max(a), 6) as intercept, round(max(b), 6) as slope from n_{name}{steps})"


@query(_T + "".join(_line_sql(k, "p", e) for k, e in _BOUNDS.items()) + _line_sql("separated", "0.2::double + 0.6::double * target", 1e-8, 1)
       + " " + " union all ".join(f"select * from r_{k}" for k in (*_BOUNDS, "separated")))
def calibration_fits(spark, sf_dir):
    """Every variant of the fit, and one whose score separates the classes: it has no optimum, and is null."""
    t = _test(spark, sf_dir).select("p", "target")
    lines = [(k, models.calibration_fit(t, eps=e)) for k, e in _BOUNDS.items()]
    lines.append(("separated", models.calibration_fit(t.withColumn("p", d(0.2) + d(0.6) * F.col("target")))))
    return spark.createDataFrame([(k, m.intercept, m.slope) for k, m in lines], "variant string, intercept double, slope double")


def _binned_frame(spark, sf_dir):
    """Written, narrow: edges, cells and scores are each made from it."""
    t, names = _fit_frame(spark, sf_dir)
    return written(t.select("panel", "split", "target", *names), "transitions"), names


@query(None)
def boosted_trees(spark, sf_dir):
    """200 trees of depth 3 on the training transitions, scored on the test ones."""
    t, names = _binned_frame(spark, sf_dir)
    model = boosting.fit_boosted(t.where("split = 'train'"), names)
    return metrics.point_scores(model.score(t.where("split = 'test'")), ["panel"])


_SHARES = "[" + ", ".join(f"{i / 255!r}" for i in range(1, 255)) + "]"
_LONG = " union all ".join(f"select 'f{i}' as feature, cast({x} as double) as x, target from tt" for i, x in enumerate(_FEATURES["multi"]["maximum_count"]))


@query(E_T + f""", tt as (select * from t where split = 'train'), lg as ({_LONG}), dv as (select feature, x from lg group by all), dn as (select feature, count(*) as c from dv group by feature),
ed as (select feature, (x + nx) / 2 as edge from (select feature, x, lead(x) over (partition by feature order by x) as nx from dv) join dn using (feature) where c <= 255 and nx is not null
  union all select distinct feature, edge from (select feature, unnest(quantile_cont(x, {_SHARES})) as edge from lg join dn using (feature) where c > 255 group by feature)),
nk as (select cast(count(*) as double) as n, cast(sum(target) as double) as k from tt),
sl as (select feature, edge, cast(count(*) filter (where x <= edge) as double) as nl, cast(coalesce(sum(target) filter (where x <= edge), 0) as double) as kl from ed join lg using (feature) group by all),
gh as (select feature, edge, nl, n, nl * (k / n) - kl as gl, (n - nl) * (k / n) - (k - kl) as gr, nl * (k / n) * (1 - k / n) as hl, (n - nl) * (k / n) * (1 - k / n) as hr from sl, nk)
select feature, round(edge, 6) as edge, cast(nl as bigint) as rows_left, round(gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1), 6) as gain
from gh where nl >= 20 and n - nl >= 20 and hl >= 1e-3 and hr >= 1e-3""")
def boosted_root_gains(spark, sf_dir):
    """The first round's search: the gain of every split of the root."""
    t, names = _binned_frame(spark, sf_dir)
    return boosting.root_gains(t.where("split = 'train'"), names)


@query(L_W + """, o as (select *, row_number() over (partition by panel, resource order by window_id) - 1 as ord, count(*) over (partition by panel, resource) as nw,
  lead(event) over (partition by panel, resource order by window_id) as target, lead(window_id) over (partition by panel, resource order by window_id) as nxt from w),
t0 as (select *, case when ord + 1 < floor(cast(0.7 as double) * nw) then 'train' else 'test' end as split from o where nxt = window_id + 1 and nw >= 20),
t as (select * from t0 where (panel, resource) in (select (panel, resource) from t0 group by panel, resource having count(*) filter (where split = 'train') >= 10 and count(*) filter (where split = 'test') >= 3)),
sa as (select resource, split, target, cast(target as double) as y""" + newton_sql.scaled_by(_RESOURCE_X, "split = 'train'", "resource") + """ from t),
sr as (select * from sa where split = 'train')""" + newton_sql.fit("fit", "sr", 3, by="resource") + f""", y as (select resource, target, 1 / (1 + exp(-({newton_sql.linear(3, False)}))) as p from sa join fit using (resource) where split = 'test')
select resource, count(*) as rows, cast(sum(target) as bigint) as positives, round(avg(target), 6) as prevalence, round(avg((target - p) * (target - p)), 6) as brier,
round(avg(target * ln(p) + (1 - target) * ln(1 - p)), 6) as mean_log_score from y group by resource""")
def resource_forecast(spark, sf_dir):
    """Per resource: a model on the training transitions, scored on the test ones."""
    names = ["f0", "f1", "f2"]
    b = resource_blocks(spark, sf_dir).select("panel", "resource", "window_id", "event", *features.features("multi", "maximum_count"))
    b = features.temporal_split(written(b, "blocks"), ["panel", "resource"], windows=20, train=10, test=3)
    # Written, narrow: the fits read it many times.
    b = written(b.select("resource", "split", "target", *names), "forecast")
    out = None
    for r in ("cpu", "memory", "disk", "network"):
        t = b.where(F.col("resource") == r)
        m = models.fit_logistic(t.where("split = 'train'"), names)
        s = metrics.point_scores(t.where("split = 'test'").withColumn("p", m.score(names)), ["resource"])
        out = s if out is None else out.unionByName(s)
    return out


@query(E_T + ", g as (select (sum(target) + 0.5::double) / (count(*) + 1) as r from t where split = 'train') select split, round(avg(r), 6) as prior from t, g group by split")
def global_prior(spark, sf_dir):
    t = event_split(spark, sf_dir)
    g = t.where("split = 'train'").agg(smoothed_rate(F.sum("target"), F.count("*")).alias("r"))
    return t.join(F.broadcast(g)).groupBy("split").agg(F.avg("r").alias("prior"))  # one row
