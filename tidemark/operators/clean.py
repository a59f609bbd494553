"""Cleaning: validity, unpivoting to resources, burst thresholds, deduplication and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import Col, clip, col, cut_index, d, finite, number
from . import ranges
from .scratch import written
from .selection import quantiles

#: Ratios may exceed 1 by this much (rounding in the source) and are clipped.
RATIO_TOP = 1.000001
BURST_CAP = 100.0
MIN_SAMPLES = 12
SHORT_INTERVAL = 180


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in columns})


def valid_ratio(x: Col) -> Column:
    return finite(x) & (col(x) >= 0) & (col(x) <= d(RATIO_TOP))


def used_ratio(used: Col, capacity: Col) -> Column:
    return F.when(col(capacity) > 0, col(used) / col(capacity))


def summed_rate(a: Col, b: Col) -> Column:
    """max(a, 0) + max(b, 0), null where either is null or NaN."""
    both = finite(a) & finite(b)
    return F.when(both, F.greatest(col(a), d(0)) + F.greatest(col(b), d(0)))


def to_resources(df: DataFrame, keys: list[str], resources: dict[str, Column]) -> DataFrame:
    """Long form (keys, resource, x): each resource by its own validity, not only complete rows."""
    # Exploded and not unpivoted: rows stay where their keys were dealt to.
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("resource"), v.cast("double").alias("x")) for k, v in resources.items()]))
    return df.select(*keys, each.alias("__r")).select(*keys, "__r.*").where(finite("x"))


def valid_resources(long: DataFrame, ratios: tuple[str, ...] = ("cpu", "memory")) -> DataFrame:
    ratio = F.col("resource").isin(*ratios)
    return long.where((ratio & valid_ratio("x")) | (~ratio & (F.col("x") >= 0)))


def at_least(df: DataFrame, keys: list[str], n: int = MIN_SAMPLES) -> DataFrame:
    return df.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).where(F.col("__n") >= n).drop("__n")


def early(share: float = 0.7, x: str = "x") -> Column:
    """Whether a row with i (from 0) and n is one of its key's first samples and positive."""
    return (F.col("i") < F.greatest(cut_index("n", share), F.lit(1))) & (F.col(x) > 0)


def burst_thresholds(ordered: DataFrame, keys: list[str], x: str = "x", share: float = 0.7, q: float = 0.99) -> DataFrame:
    """(keys, threshold): quantile of the positive values of each key's first samples; ordered has i (from 0) and n."""
    return quantiles(ordered.where(early(share, x)), keys, x, {"threshold": q})


def normalise_bursts(ordered: DataFrame, keys: list[str], x: str = "x", in_task: bool = False) -> DataFrame:
    """x over its key's training threshold, within [0, 100]; a key without positive training values has 1.

    ordered: rows of in_order(.., keep=True); the threshold reaches them by their partitions, and no task holds a key.
    in_task: rows of ranges.placed_in_task() instead.
    """
    if in_task:
        out = ordered.withColumn("threshold", F.percentile(F.when(early(x=x), F.col(x)), 0.99).over(W.partitionBy(*keys)))
    else:
        out = ranges.with_key_values(ordered, keys, burst_thresholds(ordered, keys, x)).drop(ranges.PART, ranges.AT)
    out = out.withColumn("threshold", F.coalesce("threshold", d(1)))
    return out.withColumn(x, clip(F.col(x) / F.greatest(F.col("threshold"), d(1e-12)), 0, BURST_CAP))


def in_order(df: DataFrame, keys: list[str], order: list[str], keep: bool = False) -> DataFrame:
    """df with i, the place within the key from 0, and n, the key's rows. `order` is a total order; keys may be of any size."""
    return ranges.placed(df, keys, order, keep=keep)


def members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def drop_exact_repeats(df: DataFrame, keys: list[str], order: list[str], payload: str) -> DataFrame:
    """Drop a row whose payload equals that of the row just before it, kept or not."""
    before = F.lag(payload).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__b", before).where(~F.col("__b").eqNullSafe(F.col(payload)) | F.col("__b").isNull()).drop("__b")


def drop_short_repeats(df: DataFrame, keys: list[str], seq: str, t: str, payload: str, within: int = SHORT_INTERVAL) -> DataFrame:
    """Drop a row whose payload is that of the last kept row, 0 to `within` seconds before it. (keys, seq) of kept rows.

    A row with another payload than the one before, or over `within` after it, is kept whatever went before: it begins
    a run. In a run of rising times the row kept next after row j is the first one over `within` later; every row's is
    found at once, and which of them the run's first row leads to is marked by doubling these pointers, so a run may
    have any number of rows. Runs in which time steps back are folded in their order, each in one task.
    """
    o = ranges.placed(df.select(*keys, seq, F.col(t).cast("long").alias("__t"), F.col(payload).alias("__p")), keys, [seq])
    before = o.select(*keys, (F.col("i") + 1).alias("i"), F.col("__t").alias("__bt"), F.col("__p").alias("__bp"), F.lit(True).alias("__b"))
    o = ranges.joined(o, before, [*keys, "i"], "left")
    new = F.col("__b").isNull() | ~F.col("__p").eqNullSafe(F.col("__bp")) | F.coalesce(F.col("__t") - F.col("__bt") > within, F.lit(False))
    back = F.coalesce(F.col("__t") < F.col("__bt"), F.lit(False)) & ~new
    o = o.select(*keys, seq, "__t", F.col("i").alias("__i"), new.cast("long").alias("__new"), back.alias("__back"))
    o = ranges.placed(o, keys, ["__i"], sums={"__run": F.col("__new")}).drop("i", "n")
    run = o.groupBy(*keys, "__run").agg(
        F.min("__t").alias("__lo"), F.max("__t").alias("__hi"), F.max("__back").alias("__back"), F.count_if(F.col("__t").isNull()).alias("__null"))
    # In a run of no more than `within` only the first row is kept.
    run = run.where((F.col("__hi") - F.col("__lo") > within) | F.col("__back") | (F.col("__null") > 0))
    run = written(run.select(*keys, "__run", (F.col("__back") | (F.col("__null") > 0)).alias("__fold"), F.monotonically_increasing_id().alias("__id")), "runs")
    rows = ranges.joined(o.select(*keys, seq, "__t", "__run"), run, [*keys, "__run"])
    named = ["__id", seq]
    heads = o.where("__new = 1").select(*keys, seq)
    found = _reached(rows.where("not __fold").select(*named, "__t"), seq, within).union(_folded(rows.where("__fold").select(*named, "__t"), seq, within))
    more = found.join(run.select(*keys, "__id"), "__id").select(*keys, seq)
    return heads.union(more).distinct()


def _reached(rows: DataFrame, seq: str, within: int) -> DataFrame:
    """(__id, seq) of the rows that pointers lead to from the first row of each run (__id, seq, __t) of rising times."""
    # Rows and, after rows of that time, the ends of what each row drops: the rows up to an end are one less than the next kept row's place.
    both = rows.select("__id", seq, "__t", F.lit(0).alias("__end")).union(rows.select("__id", seq, F.col("__t") + within, F.lit(1)))
    both = ranges.placed(both, ["__id"], ["__t", "__end", seq], sums={"__upto": 1 - F.col("__end")}, totals={"__all": 1 - F.col("__end")})
    place = both.where("__end = 0").select("__id", seq, (F.col("__upto") - 1).alias("__at"))
    place = written(place, "places")
    jump = both.where("__end = 1 and __upto < __all").select("__id", seq, F.col("__upto").alias("__to"))
    jump = written(jump.join(place, ["__id", seq]).select("__id", "__at", "__to"), "jumps")
    marked = place.where("__at = 0").select("__id", "__at")
    while not jump.isEmpty():
        marked = written(marked.union(marked.join(jump, ["__id", "__at"]).select("__id", F.col("__to").alias("__at"))), "marked")
        onward = jump.select("__id", F.col("__at").alias("__to"), F.col("__to").alias("__then"))
        jump = written(jump.join(onward, ["__id", "__to"]).select("__id", "__at", F.col("__then").alias("__to")), "jumps")
    return place.join(marked, ["__id", "__at"], "left_semi").select("__id", seq)


def _folded(rows: DataFrame, seq: str, within: int) -> DataFrame:
    """(__id, seq) of the rows kept, run by run, in the order of seq."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("__t").alias("t"))))
    state = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<s:bigint>>").alias("kept"))

    def step(acc: Column, row: Column) -> Column:
        gap = row["t"] - acc["last"]
        drop = F.coalesce((gap >= 0) & (gap <= within), F.lit(False))
        return F.when(drop, acc).otherwise(F.struct(row["t"].alias("last"), F.concat(acc["kept"], F.array(F.struct(row["s"].cast("long").alias("s")))).alias("kept")))

    kept = rows.groupBy("__id").agg(F.aggregate(entries, state, step, lambda a: a["kept"]).alias("k"))
    return kept.select("__id", F.explode("k").alias("k")).select("__id", F.col("k.s").cast(rows.schema[seq].dataType).alias(seq))


def keep_last(df: DataFrame, keys: list[str], t: str, order: list[str], files: str | None = None) -> DataFrame:
    """The last row per time; with `files` (files per key) only where a key has more than one."""
    last = F.row_number().over(W.partitionBy(*keys, t).orderBy(*[F.col(c).desc() for c in order])) == 1
    single = F.col(files) <= 1 if files else F.lit(False)
    return df.withColumn("__last", last).where(F.col("__last") | single).drop("__last")


def audit(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """(keys, rows, one count per check)."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in checks.items()])


def one_to_one(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails if a key repeats on either side or has no partner."""
    def once(d: DataFrame, name: str) -> DataFrame:
        return d.withColumn(name, F.count("*").over(W.partitionBy(*on)))

    j = once(a, "__l").join(once(b, "__r"), on, "full_outer")
    bad = F.coalesce((F.col("__l") == 1) & (F.col("__r") == 1), F.lit(False))
    check = F.when(~bad, F.raise_error(F.lit("keys are not one to one")).cast("int"))
    return j.where(check.isNull()).drop("__l", "__r")


def aligned_difference(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """(on, left, right, difference) over all keys of either; what lacks counts 0."""
    x = a.select(*on, F.col(value).alias("left"))
    y = b.select(*on, F.col(value).alias("right"))
    j = x.join(y, on, "full_outer").na.fill(0, ["left", "right"])
    return j.withColumn("difference", F.col("right") - F.col("left"))


def reconcile(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Keys whose values differ between two readings."""
    return aligned_difference(a, b, on, value).where("difference <> 0")
