"""Places, running sums and totals over keys of any size.

Rows are range-partitioned by key and order and written once, each with its place in its partition. A table of one row per
key and partition has each partition's counts and sums, and what came before in earlier ones; joined back on both, it
turns places within partitions into places within keys. No task holds a key: a key with a third of all rows spans a third
of the partitions. That table is joined by adaptive execution, which broadcasts it if its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: monotonically_increasing_id(): the partition is in the bits from this one on.
PART_BIT = 33
#: Columns that placed() leaves for further use by totals().
PART, AT = "__part", "__at"
#: Rows of the largest key that one task orders by itself, and about how many rows a task is dealt.
KEY_ROWS, TASK_ROWS = 100_000, 250_000


def joined(rows: DataFrame, per: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """rows with the further columns of per, which has one row or none for a value of `columns`; nulls are equal."""
    own = per.select(*[F.col(c).alias(f"__r{n}") for n, c in enumerate(columns)], *[c for c in per.columns if c not in columns])
    cond = F.lit(True)
    for n, c in enumerate(columns):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r{n}"))
    return rows.join(own, cond, how).drop(*[f"__r{n}" for n in range(len(columns))])


def placed(
    df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None, parts: int | None = None, keep: bool = False,
) -> DataFrame:
    """df with i, the place within its key from 0 by `order` (a total order), and n, the key's rows.

    sums: running sums up to and including each row; totals: sums over the key; both of columns of df that are never
    null. Null keys are a key of their own; nulls of the order come first. keep: leave the columns of totals_by_part().
    """
    sums, totals = sums or {}, totals or {}
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    rows = df.withColumns({f"__s{k}": c for k, c in enumerate(sums.values())} | {f"__t{k}": c for k, c in enumerate(totals.values())})
    rows = written(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(AT, F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn(PART, F.shiftright(AT, PART_BIT))
    added = [f"__s{k}" for k in range(len(sums))]
    seg = rows.groupBy(*keys, PART).agg(
        F.min(AT).alias("__first"), F.count("*").alias("__c"), *[F.sum(c).alias(f"{c}c") for c in added],
        *[F.sum(f"__t{k}").alias(f"__t{k}c") for k in range(len(totals))],
    )
    # At most a row more than partitions for each key.
    whole = W.partitionBy(*keys)
    before = whole.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    seg = seg.select(
        *keys, PART, "__first", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("n"),
        *[F.coalesce(F.sum(f"{c}c").over(before), F.lit(0)).alias(f"{c}b") for c in added],
        *[F.sum(f"__t{k}c").over(whole).alias(name) for k, name in enumerate(totals)],
    )
    out = joined(rows, seg, [*keys, PART])
    out = out.withColumn("i", F.col("__before") + F.col(AT) - F.col("__first"))
    upto = W.partitionBy(PART, *keys).orderBy(AT).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumns({name: F.col(f"__s{k}b") + F.sum(f"__s{k}").over(upto) for k, name in enumerate(sums)})
    gone = ["__first", "__before", *added, *[f"{c}b" for c in added], *[f"__t{k}" for k in range(len(totals))]]
    return out.drop(*gone, *([] if keep else [PART, AT]))


def by_size(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that one task may hold, dealt by key to as many tasks as there are rows for, and those of larger keys, if any.

    What is grouped or ordered by the key needs no further shuffle then. Null is a key.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("__n"))
    rows, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // TASK_ROWS))
    if (most or 0) <= KEY_ROWS:
        return df.repartition(parts, key), None
    large = sizes.where(F.col("__n") > KEY_ROWS).select(F.col(key).alias("__key"))
    same = F.col(key).eqNullSafe(F.col("__key"))
    return df.join(large, same, "left_anti").repartition(parts, key), df.join(large, same, "left_semi")


def placed_in_task(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """placed() for keys that one task may hold."""
    by = W.partitionBy(*keys)
    return df.withColumns({"i": (F.row_number().over(by.orderBy(*order)) - 1).cast("long"), "n": F.count("*").over(by)})


def totals_by_part(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Rows of placed(.., keep=True) with further sums over their key, by way of the key's sums in each partition."""
    seg = df.groupBy(*keys, PART).agg(*[F.sum(c).alias(k) for k, c in totals.items()])
    whole = W.partitionBy(*keys)
    seg = seg.select(*keys, PART, *[F.sum(k).over(whole).alias(k) for k in totals])
    return joined(df, seg, [*keys, PART])


def with_key_values(df: DataFrame, keys: list[str], per_key: DataFrame) -> DataFrame:
    """Rows of placed(.., keep=True) with per_key's columns (null where it lacks the key): per_key goes to the key's partitions first."""
    parts = df.select(*keys, PART).distinct()
    own = per_key.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(keys)], *[c for c in per_key.columns if c not in keys])
    cond = F.lit(True)
    for n, c in enumerate(keys):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k{n}"))
    seg = parts.join(own, cond, "left").drop(*[f"__k{n}" for n in range(len(keys))])
    return joined(df, seg, [*keys, PART])
