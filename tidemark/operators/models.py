"""Penalised logistic models by Newton steps over aggregates; transfer, calibration and coefficient tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import d, expit, softplus
from .scratch import written

STEPS, TOLERANCE = 25, 1e-9


@dataclass(frozen=True)
class Logistic:
    intercept: float
    coefficients: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def linear(self, names: list[str], offset: Column | None = None) -> Column:
        """The linear predictor as a literal expression, so that scoring needs no shuffle and no UDF."""
        z = d(self.intercept) if offset is None else offset + d(self.intercept)
        for c, b, m, s in zip(names, self.coefficients, self.means, self.scales, strict=True):
            z = z + d(b) * (F.col(c) - d(m)) / d(s)
        return z

    def score(self, names: list[str], offset: Column | None = None) -> Column:
        return expit(self.linear(names, offset))

    def row(self, **keys) -> dict:
        return keys | {"intercept": self.intercept, "coefficients": json.dumps([round(c, 12) for c in self.coefficients])}


def _scaling(train: DataFrame, names: list[str], floor: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    if not names:
        return (), ()
    r = train.agg(*[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    k = len(names)
    return tuple(float(x or 0) for x in r[:k]), tuple(1.0 if not x or x < floor else float(x) for x in r[k:])


def fit_logistic(
    train: DataFrame, names: list[str], target: str = "target", offset: str | None = None, l2: float = 1.0,
    standardised: bool = True, floor: float = 1e-8,
) -> Logistic:
    """Minimise sum(softplus(z) - y z) + l2 / 2 |b|^2 with a free intercept, z = offset + a + b x.

    Each Newton step is one aggregation of the gradient and the Hessian; (d + 1)(d + 4) / 2 numbers reach the driver.
    """
    keep = [F.col(c).cast("double").alias(c) for c in names] + [F.col(target).cast("double").alias("__y")]
    keep.append((F.col(offset) if offset else d(0)).alias("__o"))
    t = train.select(*keep).persist()
    try:
        means, scales = _scaling(t, names, floor) if standardised else ((0.0,) * len(names), (1.0,) * len(names))
        x = [d(1), *[(F.col(c) - d(m)) / d(s) for c, m, s in zip(names, means, scales, strict=True)]]
        k = len(x)
        beta = np.zeros(k)
        ridge = np.diag([0.0] + [l2] * (k - 1))
        for _ in range(STEPS):
            z = F.col("__o")
            for b, c in zip(beta.tolist(), x, strict=True):
                z = z + d(b) * c
            p = expit(z)
            s = t.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], (p - F.col("__y")).alias("g"), (p * (1 - p)).alias("w"))
            sums = [F.sum(F.col("g") * F.col(f"x{i}")) for i in range(k)]
            sums += [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i + 1)]
            r = [float(v or 0) for v in s.agg(*[v.alias(f"v{n}") for n, v in enumerate(sums)]).first()]
            g = np.array(r[:k]) + ridge @ beta
            h, at = np.zeros((k, k)), k
            for i in range(k):
                for j in range(i + 1):
                    h[i, j] = h[j, i] = r[at]
                    at += 1
            step = np.linalg.solve(h + ridge + 1e-12 * np.eye(k), g)
            beta = beta - np.clip(step, -5, 5)
            if np.abs(step).max() < TOLERANCE:
                break
    finally:
        t.unpersist()
    return Logistic(float(beta[0]), tuple(beta[1:].tolist()), means, scales)


def fit_mean_loss(train: DataFrame, names: list[str], target: str = "target") -> Logistic:
    """Mean loss with |b|^2 / (2 n): the same optimum as fit_logistic with l2 = 1."""
    return fit_logistic(train, names, target, floor=5e-324)


@dataclass(frozen=True)
class Line:
    """A calibration line; state: converged, separated (no finite optimum), constant (no slope) or stopped."""

    state: str
    intercept: float | None = None
    slope: float | None = None


def calibration_fit(scored: DataFrame, p: str = "p", target: str = "target", eps: float = 1e-8, steps: int = 50) -> Line:
    """Intercept and slope of the target's logit on the score's, unpenalised, by Newton's steps with a line search.

    Whether an optimum exists is read from the classes' ranges first: both must overlap. eps: scores are clipped to
    [eps, 1 - eps]. Rows of equal scores are summed once, so a step reads distinct scores only.
    """
    q = F.least(F.greatest(F.col(p), d(eps)), d(1 - eps))
    z = scored.select(F.ln(q / (1 - q)).alias("z"), F.col(target).cast("double").alias("y")).where("z is not null and y is not null")
    z = written(z.groupBy("z").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k")), "scores")
    of = lambda f, c: f(F.when(c, F.col("z")))
    zero, one = F.col("k") < F.col("n"), F.col("k") > 0
    r = z.agg(F.min("z").alias("lo"), F.max("z").alias("hi"), *[of(f, c).alias(f"{k}{s}") for s, c in (("0", zero), ("1", one)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if r.lo is None or r.lo == r.hi:
        return Line("constant")
    if r.lo0 is None or r.lo1 is None or r.hi0 <= r.lo1 or r.hi1 <= r.lo0:
        return Line("separated")

    def at(a: float, b: float) -> list[float]:
        """Loss, gradient and Hessian."""
        eta = d(a) + d(b) * F.col("z")
        mu = expit(eta)
        w = F.col("n") * mu * (1 - mu)
        g = F.col("n") * mu - F.col("k")
        sums = [F.col("n") * softplus(eta) - F.col("k") * eta, g, g * F.col("z"), w, w * F.col("z"), w * F.col("z") * F.col("z")]
        return [float(v) for v in z.agg(*[F.sum(s).alias(f"v{i}") for i, s in enumerate(sums)]).first()]

    beta, now = np.array([0.0, 1.0]), None
    for _ in range(steps):
        now = now or at(*beta)
        step = np.linalg.lstsq(np.array([[now[3], now[4]], [now[4], now[5]]]), np.array(now[1:3]), rcond=None)[0]
        if np.abs(step).max() < TOLERANCE * max(1.0, np.abs(beta).max()):
            return Line("converged", *beta.tolist())
        size = 1.0
        while (new := at(*(beta - size * step)))[0] > now[0] + 1e-9 * abs(now[0]) and size > 1e-6:
            size /= 2
        beta, now = beta - size * step, new
    return Line("stopped")


def calibration_line(scored: DataFrame, p: str = "p", target: str = "target", eps: float = 1e-8) -> tuple[float | None, float | None]:
    """Intercept and slope of calibration_fit(), null where there is no optimum."""
    m = calibration_fit(scored, p, target, eps)
    return m.intercept, m.slope


def coefficient_table(spark: SparkSession, models: list[dict]) -> DataFrame:
    """Rows (keys, intercept, coefficients as JSON text) with the array beside it."""
    t = spark.createDataFrame(models)
    return t.withColumn("values", F.from_json("coefficients", "array<double>"))
