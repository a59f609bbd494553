"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def d(x: float) -> Column:
    """A double literal; a bare 0.7 would be a decimal in SQL."""
    return F.lit(float(x))


def floor_id(t: Col, width: int) -> Column:
    """Window number of a time by floor division (negative times too)."""
    return F.floor(col(t) / F.lit(float(width))).cast("long")


def number(c: Col) -> Column:
    """Text to double; what is no number is null."""
    return col(c).try_cast("double")


def finite(c: Col) -> Column:
    """True for numbers other than NaN and infinities, false for null."""
    x = col(c)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def clip(c: Col, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), d(low)), d(high))


def clip_p(c: Col, eps: float) -> Column:
    return clip(c, eps, 1 - eps)


def logit(c: Col) -> Column:
    return F.ln(col(c) / (1 - col(c)))


def expit(c: Col) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def softplus(c: Col) -> Column:
    """ln(1 + e^z) without overflow."""
    return F.greatest(col(c), d(0)) + F.log1p(F.exp(-F.abs(col(c))))


def smoothed_rate(k: Col, n: Col) -> Column:
    return (col(k) + d(0.5)) / (col(n) + d(1))


def core_feature(c: Col) -> Column:
    return F.log2(F.greatest(col(c), d(1)))


def near(c: Col, target: float, atol: float = 1e-12, rtol: float = 0.0) -> Column:
    return F.abs(col(c) - d(target)) <= d(atol + rtol * abs(target))


def flag(c: Column) -> Column:
    """A condition as 0 or 1."""
    return c.cast("int").cast("long")


def stem_id(path: Col) -> Column:
    """The integer stem of a file name, null if it isn't one."""
    return F.regexp_extract(col(path), r"([^/]*?)(\.[^./]*)?$", 1).try_cast("long")


def cut_index(n: Col, share: float) -> Column:
    """int(share * n) with the product in doubles."""
    return F.floor(d(share) * col(n)).cast("long")
