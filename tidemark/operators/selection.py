"""Exact quantiles of groups of any size, by distributed selection.

Doubles map to 64-bit numbers of the same order. A histogram of the highest 16 bits tells which bin holds a rank; only
that bin's rows are counted by their next 16 bits, and so on: four passes, whatever the values, and never more than 65,536
counts for a group and rank. F.percentile would keep every distinct value of a group in one buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

STEP, ROUNDS = 16, 4


def ordered_bits(x: Column) -> Column:
    """A bigint in the order of the double x; -0.0 counts as 0.0, NaN is the greatest."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1).cast("bigint"))).otherwise(bits)


def order_statistics(df: DataFrame, keys: list[str], x: str, ranks: Column) -> DataFrame:
    """(keys, n, ranks array<struct<rank, value>>): a group's rows and its values at these places, from 0; ranks: array<bigint> from `n`.

    Null values are no rows; a rank beyond the group has no entry. The values are written once and read in each pass.
    """
    v = written(df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"), ordered_bits(F.col(x)).alias("__bits")), "selection")
    n = v.groupBy(*keys).agg(F.count("*").alias("n"))
    # What is sought in each bin: the rank in the group, and in the bin. At first a group is one bin.
    sought = F.transform(F.array_distinct(ranks), lambda r: F.struct(r.alias("rank"), r.alias("left")))
    bins = n.select(*keys, F.lit(0).cast("bigint").alias("__in"), F.col("n").alias("__n"), sought.alias("__sought"))
    for k in range(ROUNDS):
        shift = 64 - STEP * (k + 1)
        own = bins.select(*[F.col(c).alias(f"__k{m}") for m, c in enumerate(keys)], F.col("__in").alias("__of"), "__n", "__sought")
        cond = F.shiftright("__bits", shift + STEP) == F.col("__of") if k else F.lit(True)
        for m, c in enumerate(keys):
            cond = cond & F.col(c).eqNullSafe(F.col(f"__k{m}"))
        if k or keys:
            # Counts come first in the first pass, in which every row is in a bin that is sought.
            rows = v.join(own, cond) if k else v.groupBy(*keys, F.shiftright("__bits", shift).alias("__next")).agg(F.count("*").alias("__c"), F.min("__x").alias("__value")).join(own, cond)
        else:
            rows = v.groupBy(F.shiftright("__bits", shift).alias("__next")).agg(F.count("*").alias("__c"), F.min("__x").alias("__value")).join(F.broadcast(own))  # one row
        if k:
            rows = rows.groupBy(*keys, "__of", F.shiftright("__bits", shift).alias("__next")).agg(
                F.count("*").alias("__c"), F.min("__x").alias("__value"), F.first("__n").alias("__n"), F.first("__sought").alias("__sought"))
        upto = W.partitionBy(*keys, "__of").orderBy("__next").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("__before", F.coalesce(F.sum("__c").over(upto), F.lit(0)))
        inside = F.filter("__sought", lambda s: (s["left"] >= F.col("__before")) & (s["left"] < F.col("__before") + F.col("__c")))
        rows = rows.withColumn("__sought", inside).where(F.size("__sought") > 0)
        if k < ROUNDS - 1:
            left = F.transform("__sought", lambda s: F.struct(s["rank"].alias("rank"), (s["left"] - F.col("__before")).alias("left")))
            bins = rows.select(*keys, F.col("__next").alias("__in"), "__n", left.alias("__sought"))
    entry = F.transform("__sought", lambda s: F.struct(s["rank"].alias("rank"), F.col("__value").alias("value")))
    return rows.groupBy(*keys).agg(F.first("__n").alias("n"), F.flatten(F.collect_list(entry)).alias("ranks"))


def quantiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column per share): exact quantiles with linear interpolation, as F.percentile gives them; groups without values are left out."""
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array(*[f(at(q)).cast("bigint") for q in shares.values() for f in (F.floor, F.ceil)])
    found = order_statistics(df, keys, x, ranks)
    out = found.withColumn("__v", F.map_from_entries("ranks"))

    def value(q: float) -> Column:
        low, high = F.floor(at(q)).cast("bigint"), F.ceil(at(q)).cast("bigint")
        a, b = F.element_at("__v", low), F.element_at("__v", high)
        return F.when((low == high) | (a == b), a).otherwise((high - at(q)) * a + (at(q) - low) * b)

    return out.select(*keys, *[value(q).alias(name) for name, q in shares.items()])
