"""Scores of probabilistic forecasts. df has the columns p and target (0 or 1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip_p, d
from .ranges import placed
from .selection import quantiles


def _grouped(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Rows __n and positives __k per distinct score, so that the ranking is over distinct scores only."""
    n = F.sum(weight) if weight else F.count("*")
    k = F.sum(F.col(weight) * F.col("target")) if weight else F.sum("target")
    return df.groupBy(*keys, "p").agg(n.alias("__n"), k.alias("__k"))


def average_precision(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Precision at each distinct score, weighted by its positives; ties are one step. weight: multiplicity of rows."""
    g = placed(_grouped(df, keys, weight), keys, [F.col("p").desc()], sums={"__tp": F.col("__k"), "__nn": F.col("__n")})
    step = F.try_divide(F.col("__k") * F.col("__tp").cast("double"), F.col("__nn"))
    return g.groupBy(*keys).agg(F.try_divide(F.sum(step), F.sum("__k")).alias("average_precision"))


def average_precision_stable(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Precision at each positive row in order of score and then `order`: ties are not one step."""
    r = placed(df.select(*keys, "p", "target", *order), keys, [F.col("p").desc(), *order], sums={"__tp": F.col("target")})
    at = F.when(F.col("target") == 1, F.col("__tp") / (F.col("i") + 1))
    return r.groupBy(*keys).agg(F.avg(at).alias("average_precision_stable"))


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """By average ranks, from counts per distinct score."""
    g = _grouped(df, keys).withColumn("__neg", F.col("__n") - F.col("__k"))
    g = placed(g, keys, ["p"], sums={"__upto": F.col("__neg")}).withColumn("__below", F.col("__upto") - F.col("__neg"))
    wins = F.sum(F.col("__k") * (F.col("__below") + d(0.5) * F.col("__neg")))
    return g.groupBy(*keys).agg(F.try_divide(wins, F.sum("__k") * F.sum("__neg").cast("double")).alias("roc_auc"))


def brier() -> Column:
    return F.avg((F.col("target") - F.col("p")) ** 2)


def log_score(eps: float = 1e-12) -> Column:
    p = clip_p("p", eps)
    return F.avg(F.col("target") * F.ln(p) + (1 - F.col("target")) * F.ln(1 - p))


def point_scores(df: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum("target").alias("positives"), F.avg(F.col("target").cast("double")).alias("prevalence"),
        brier().alias("brier"), log_score(eps).alias("mean_log_score"),
    )


def calibration_error(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Mean absolute gap of equal-width bins (low, high], weighted by their rows."""
    at = sum((F.when(F.col("p") > d(i / bins), 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    b = df.withColumn("__bin", at).groupBy(*keys, "__bin").agg(
        F.count("*").alias("__n"), F.abs(F.avg("p") - F.avg(F.col("target").cast("double"))).alias("__gap")
    )
    return b.groupBy(*keys).agg((F.sum(F.col("__n") * F.col("__gap")) / F.sum("__n")).alias(f"ece_{bins}"))


def reliability_bins(df: DataFrame, keys: list[str], order: list[str], bins: int = 10) -> DataFrame:
    """Equal-frequency bins by score, the larger first: rows, mean score, observed rate."""
    b = placed(df.select(*keys, "p", "target", *order), keys, ["p", *order])
    size, more = F.floor(F.col("n") / bins), F.col("n") % bins
    late = more + F.floor((F.col("i") - more * (size + 1)) / size)
    b = b.withColumn("bin", (1 + F.when(F.col("i") < more * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(late)).cast("long"))
    return b.groupBy(*keys, "bin").agg(
        F.count("*").alias("rows"), F.avg("p").alias("mean_p"), F.avg(F.col("target").cast("double")).alias("observed")
    )


def alerts(df: DataFrame, keys: list[str], order: list[str], fraction: float = 0.01) -> DataFrame:
    """The top ceil(fraction * rows) scores, ties by `order`: alerts, recall and precision."""
    r = placed(df.select(*keys, "p", "target", *order), keys, [F.col("p").desc(), *order])
    hit = F.col("i") < F.ceil(d(fraction) * F.col("n"))
    g = r.groupBy(*keys).agg(
        F.count_if(hit).alias("alerts"), F.sum(F.when(hit, F.col("target")).otherwise(0)).alias("__tp"), F.sum("target").alias("__k")
    )
    return g.select(*keys, "alerts", F.try_divide("__tp", "__k").alias("alert_recall"), F.try_divide("__tp", "alerts").alias("alert_precision"))


def best_budget(df: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """The `budget` rows of greatest p: the choice that captures most in expectation."""
    return df.orderBy(F.col("p").desc(), *order).limit(budget)


def entity_gain(df: DataFrame, entity: str, left: str, right: str, eps: float = 1e-12) -> DataFrame:
    """(entity, positives, gain): mean log score of `right` minus `left`."""
    def score(c: str) -> Column:
        p = clip_p(c, eps)
        return F.avg(F.col("target") * F.ln(p) + (1 - F.col("target")) * F.ln(1 - p))

    return df.groupBy(entity).agg(F.sum("target").alias("positives"), (score(right) - score(left)).alias("gain"))


def gain_summary(gains: DataFrame) -> DataFrame:
    g = gains.where("positives > 0")
    middle = F.broadcast(quantiles(g, [], "gain", {"median_gain": 0.5}))  # one row
    return g.agg(F.count("*").alias("entities"), F.count_if(F.col("gain") > 0).alias("wins")).join(middle)


def sign_test(wins: int, n: int) -> float:
    """Two-sided exact binomial test of wins among n."""
    k = min(wins, n - wins)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
