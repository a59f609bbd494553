"""Resampling: clusters, blocks and seeds. Draws are a digest of (replicate, draw), the same in any engine.

Rows are aggregated to one per cluster first; replicates join those few rows, never the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import d
from .metrics import average_precision
from .ranges import placed


def draw(replicate: Column, k: Column, n: Column) -> Column:
    """A number of [0, n)."""
    text = F.concat(replicate.cast("string"), F.lit("-"), k.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def draws(spark: SparkSession, replicates: int, n: int) -> DataFrame:
    """(rep, k, pick): n draws with replacement for each replicate."""
    grid = spark.range(replicates).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    return grid.withColumn("pick", draw(F.col("rep"), F.col("k"), F.lit(n)))


def multiplicities(spark: SparkSession, replicates: int, n: int) -> DataFrame:
    """(rep, pick, times): a row for each cluster a replicate holds."""
    return draws(spark, replicates, n).groupBy("rep", "pick").agg(F.count("*").alias("times"))


def numbered(clusters: DataFrame, key: str) -> DataFrame:
    """Clusters with `pick`, their place by key. Clusters are one row each, so one task may number them."""
    return clusters.withColumn("pick", (F.row_number().over(W.orderBy(key)) - 1).cast("long"))


def interval(reps: DataFrame, keys: list[str], value: str) -> DataFrame:
    return reps.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high")
    )


def cluster_ratio(clusters: DataFrame, key: str, total: str, weight: str, replicates: int) -> DataFrame:
    """(mean, low, high) of sum(total) / sum(weight) over resampled clusters."""
    c = numbered(clusters, key)
    n = c.count()
    m = multiplicities(c.sparkSession, replicates, n).join(c, "pick")
    r = m.groupBy("rep").agg((F.sum(F.col("times") * F.col(total)) / F.sum(F.col("times") * F.col(weight))).alias("value"))
    return interval(r, [], "value")


def cluster_mean(clusters: DataFrame, key: str, value: str, replicates: int) -> DataFrame:
    """(mean, low, high) of the mean of a value per cluster."""
    return cluster_ratio(clusters.withColumn("__one", d(1)), key, value, "__one", replicates)


def seed_means(runs: DataFrame, key: str, by: list[str], values: list[str], replicates: int) -> DataFrame:
    """(by, metric, seeds, mean, low, high) of each value's mean over resampled runs, a row per (by, key); all groups draw alike.

    Runs are numbered within their group; a replicate joins those numbers only, and means are over whole replicates.
    """
    long = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    at = (F.row_number().over(W.partitionBy(*by).orderBy(key)) - 1).cast("long")
    c = runs.withColumns({"pick": at, "seeds": F.count("*").over(W.partitionBy(*by))})
    c = c.select(*by, "pick", "seeds", long.alias("v")).select(*by, "pick", "seeds", "v.*")
    reps = c.select(*by, "seeds").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    reps = reps.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("seeds") - 1).cast("int"))))
    m = reps.select(*by, "rep", draw(F.col("rep"), F.col("k"), F.col("seeds")).alias("pick")).groupBy(*by, "rep", "pick").agg(F.count("*").alias("times"))
    r = m.join(c, [*by, "pick"]).groupBy(*by, "metric", "seeds", "rep").agg((F.sum(F.col("times") * F.col("value")) / F.sum("times")).alias("value"))
    return interval(r, [*by, "metric", "seeds"], "value")


def pooled_precision(scored: DataFrame, cluster: str, replicates: int) -> DataFrame:
    """(mean, low, high) of the pooled average precision; rows are weighted by multiplicity, not repeated.

    Scores are first summed per (cluster, p), so a replicate joins distinct scores only.
    """
    g = scored.groupBy(cluster, "p").agg(F.count("*").alias("n"), F.sum("target").alias("k"))
    c = numbered(scored.select(cluster).distinct(), cluster)
    m = multiplicities(scored.sparkSession, replicates, c.count()).join(c, "pick").join(g, cluster)
    pos = m.select("rep", "p", (F.col("times") * F.col("k")).alias("w"), F.lit(1).alias("target"))
    neg = m.select("rep", "p", (F.col("times") * (F.col("n") - F.col("k"))).alias("w"), F.lit(0).alias("target"))
    return interval(average_precision(pos.union(neg), ["rep"], "w"), [], "average_precision")


def precision_gain(scored: DataFrame, cluster: str, left: str, right: str, replicates: int) -> DataFrame:
    """(mean, low, high) of the mean difference of per-cluster average precision, over clusters with both classes."""
    both = scored.groupBy(cluster).agg(F.min("target").alias("a"), F.max("target").alias("b")).where("a <> b").select(cluster)
    s = scored.join(both, cluster)
    ap = lambda c, name: average_precision(s.withColumn("p", F.col(c)), [cluster]).withColumnRenamed("average_precision", name)
    gain = ap(left, "l").join(ap(right, "r"), cluster).select(cluster, (F.col("r") - F.col("l")).alias("gain"))
    return cluster_mean(gain, cluster, "gain", replicates)


def block_starts(s: DataFrame, key: str, replicates: int, length: int) -> DataFrame:
    """(key, rep, start, whole): starts drawn for circular blocks of `length`, as long together as the series; s: rows of placed().

    A series that is no multiple of `length` has a last block of its rest, which is not whole. Replicates are dealt to all
    tasks before their draws are made.
    """
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = s.groupBy(key).agg(F.first("n").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    reps = reps.repartition(parts, key, "rep").withColumn("__k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / length) - 1).cast("int"))))
    return reps.select(key, "rep", draw(F.col("rep"), F.col("__k"), F.col("n")).alias("start"), ((F.col("__k") + 1) * length <= F.col("n")).alias("whole"))


def in_blocks(s: DataFrame, length: int) -> DataFrame:
    """Rows of placed() once for each circular block that holds them: its start, j (the place within), rest (rows of a last block)."""
    b = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return b.withColumns({"start": F.pmod(F.col("i") - F.col("j"), F.col("n")), "rest": F.col("n") % length})


def block_multiplicities(series: DataFrame, key: str, order: str, replicates: int, length: int = 12) -> tuple[DataFrame, DataFrame]:
    """The series with `at`, their places, and (key, rep, at, times): how often each place is in a replicate's blocks.

    Every key's series is numbered and drawn by itself, so no task sees more than one.
    """
    s = placed(series, [key], [order])
    b = in_blocks(s.select(key, "i", "n"), length).select(key, "start", F.col("i").alias("at"), (F.col("j") < F.col("rest")).alias("cut"))
    m = block_starts(s, key, replicates, length).join(b, [key, "start"]).where(F.col("whole") | F.col("cut"))
    return s.withColumnRenamed("i", "at").drop("n"), m.groupBy(key, "rep", "at").agg(F.count("*").alias("times"))


def block_recall(series: DataFrame, key: str, order: str, hit: Column, event: str, replicates: int, length: int = 12) -> DataFrame:
    """(key, mean, low, high) of event recall over resampled blocks of each key's series.

    Every block is summed once, whole and cut; draws join these sums, so a replicate has a row per block, not per place.
    """
    s = placed(series.select(key, order, F.col(event).alias("__e"), (hit.cast("double") * F.col(event)).alias("__h")), [key], [order])
    cut = {c: F.when(F.col("j") < F.col("rest"), F.col(f"__{c}")) for c in "eh"}
    sums = [F.sum(x).alias(name) for c in "eh" for x, name in ((F.col(f"__{c}"), f"__{c}_whole"), (cut[c], f"__{c}_cut"))]
    b = in_blocks(s, length).groupBy(key, "start").agg(*sums)
    m = block_starts(s, key, replicates, length).join(b, [key, "start"])
    of = lambda c: F.sum(F.when(F.col("whole"), F.col(f"__{c}_whole")).otherwise(F.col(f"__{c}_cut")))
    return interval(m.groupBy(key, "rep").agg(F.try_divide(of("h"), of("e")).alias("value")), [key], "value")


def block_precision_gain(series: DataFrame, key: str, order: str, left: str, right: str, replicates: int, length: int = 12) -> DataFrame:
    """(key, mean, low, high) of the difference of average precision over resampled blocks of each key's series.

    Draws join blocks as arrays of their `length` rows; a replicate's rows are summed per distinct score as they are unpacked.
    """
    s = placed(series.select(key, order, F.col(left).alias("__l"), F.col(right).alias("__r"), "target"), [key], [order])
    b = in_blocks(s, length).groupBy(key, "start").agg(F.first("rest").alias("rest"), F.collect_list(F.struct("j", "__l", "__r", "target")).alias("__rows"))
    m = block_starts(s, key, replicates, length).join(b, [key, "start"])
    taken = F.when(F.col("whole"), F.col("__rows")).otherwise(F.filter("__rows", lambda x: x["j"] < F.col("rest")))
    m = m.select(key, "rep", F.explode(taken).alias("__x"))
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(f"__x.__{c}").alias("p")) for c in "lr"]))
    m = m.select(key, "rep", F.col("__x.target").alias("target"), both.alias("__y")).select(key, "rep", "__y.*", "target")
    by = [key, "rep", "side"]
    ap = average_precision(m.groupBy(*by, "p", "target").agg(F.count("*").alias("times")), by, "times")
    of = lambda c: F.max(F.when(F.col("side") == c, F.col("average_precision")))
    return interval(ap.groupBy(key, "rep").agg((of("r") - of("l")).alias("value")), [key], "value")
