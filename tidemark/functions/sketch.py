"""Mergeable window states: logarithmic sketches, maximum with count, payload sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import Col, clip, col, d

#: Fixed values of the sketch: relative error, and the key of values that have no logarithm.
RELATIVE_ERROR = 0.01
ZERO_KEY = -10000
#: Fixed values of the binary size model: bytes of metadata, of a number, of maximum and count, of a sketch's head and bin.
METADATA_BYTES, NUMBER_BYTES, MAX_COUNT_BYTES, SKETCH_HEAD_BYTES, BIN_BYTES = 12, 8, 12, 2, 6


def gamma_of(error: float = RELATIVE_ERROR) -> float:
    return (1 + error) / (1 - error)


def bucket_key(x: Col, error: float = RELATIVE_ERROR) -> Column:
    """ceil(ln x / ln gamma); zero and less go to a key of their own."""
    safe = F.when(col(x) > 0, col(x)).otherwise(d(1))
    return F.when(col(x) > 0, F.ceil(F.ln(safe) / d(math.log(gamma_of(error))))).otherwise(F.lit(ZERO_KEY)).cast("long")


def bucket_value(key: Col, error: float = RELATIVE_ERROR) -> Column:
    """What stands for a bucket, within [0, 1]; 0 for the zero key."""
    g = gamma_of(error)
    return F.when(col(key) == ZERO_KEY, d(0)).otherwise(clip(d(2 / (1 + g)) * F.pow(d(g), col(key).cast("double")), 0, 1))


def sketch_rows(samples: DataFrame, keys: list[str], x: str = "x", error: float = RELATIVE_ERROR) -> DataFrame:
    """(keys, bucket, n): the sketch as rows, which merge by summing n."""
    return samples.groupBy(*keys, bucket_key(x, error).alias("bucket")).agg(F.count("*").alias("n"))


def merge_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def sketch_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sketch map<bucket, n>); a window's buckets are few by the sketch's own bound."""
    entries = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    return rows.groupBy(*keys).agg(F.map_from_entries(entries).alias("sketch"))


def merged_halves(samples: DataFrame, first: Column, keys: list[str], x: str = "x", error: float = RELATIVE_ERROR) -> DataFrame:
    """(keys, samples, bins, a, b): what two sketches of a window, of its samples with `first` and of the rest, have when merged; a and b are theirs as maps.

    Both are grouped at once, by bucket and then by window, so neither is joined to the other.
    """
    half = lambda c: F.count_if(c).alias("a" if c is first else "b")
    rows = samples.groupBy(*keys, bucket_key(x, error).alias("bucket")).agg(F.count("*").alias("n"), half(first), half(~first))
    held = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("bucket", F.col(c).alias("n"))))))
    return rows.groupBy(*keys).agg(F.sum("n").alias("samples"), F.count("*").alias("bins"), held("a").alias("a"), held("b").alias("b"))


def merge_maps(a: Col, b: Col) -> Column:
    return F.map_zip_with(col(a), col(b), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def sketch_summary(rows: DataFrame, keys: list[str], threshold: float, error: float = RELATIVE_ERROR) -> DataFrame:
    """(keys, sketch_max, sketch_count, sketch_bins) of sketch rows; bins of non-positive values don't count, 1 at least."""
    v = bucket_value("bucket", error)
    return rows.groupBy(*keys).agg(
        F.max(v).alias("sketch_max"),
        F.sum(F.when(v >= d(threshold), F.col("n")).otherwise(0)).alias("sketch_count"),
        F.greatest(F.count_if(F.col("bucket") != ZERO_KEY), F.lit(1)).alias("sketch_bins"),
    )


def sketch_payload(sketch: Col) -> Column:
    """The sketch map as sorted (bucket, n) pairs."""
    return F.array_sort(F.map_entries(col(sketch)))


def payload_bytes(method: str, bins: Col | None = None, samples: int = 12) -> Column:
    """Modelled bytes of a window's message."""
    own = {
        "snapshot": F.lit(NUMBER_BYTES), "mean": F.lit(NUMBER_BYTES), "exact_p95": F.lit(NUMBER_BYTES),
        "maximum": F.lit(NUMBER_BYTES), "maximum_count": F.lit(MAX_COUNT_BYTES), "raw": F.lit(NUMBER_BYTES * samples),
    }
    if method == "log_sketch":
        return (SKETCH_HEAD_BYTES + BIN_BYTES * col(bins) + METADATA_BYTES).cast("long")
    return (own[method] + METADATA_BYTES).cast("long")


def collector_bytes(method: str, bins: Col | None = None, samples: int = 12) -> Column:
    """Modelled bytes of a window's state while it is open."""
    if method == "log_sketch":
        return (SKETCH_HEAD_BYTES + BIN_BYTES * col(bins)).cast("long")
    n = {"snapshot": 8, "mean": 16, "exact_p95": 8 * samples, "maximum": 8, "maximum_count": 12, "raw": 8 * samples}
    return F.lit(n[method]).cast("long")


def json_payload(fields: dict[str, Col], digits: int = 6) -> Column:
    """Compact JSON with keys in order; doubles rounded."""
    return F.to_json(F.struct(*[F.round(col(v), digits).alias(k) if k.startswith("v_") else col(v).alias(k) for k, v in sorted(fields.items())]))


#: Aggregates that make a window's state from samples, and that merge two halves' states: (build, merge, finish).
STATES = {
    "mean": (
        lambda x, u: [F.sum(x).alias("total"), F.count("*").alias("n")],
        lambda: [F.sum("total").alias("total"), F.sum("n").alias("n")],
        lambda u: F.col("total") / F.col("n"),
    ),
    "exact_p95": (
        lambda x, u: [F.collect_list(x).alias("kept")],
        lambda: [F.flatten(F.collect_list("kept")).alias("kept")],
        lambda u: quantile_of("kept", 0.95),
    ),
    "maximum": (
        lambda x, u: [F.max(x).alias("maximum")],
        lambda: [F.max("maximum").alias("maximum")],
        lambda u: F.col("maximum"),
    ),
    "maximum_count": (
        lambda x, u: [F.max(x).alias("top"), F.count_if(col(x) >= d(u)).alias("over")],
        lambda: [F.max("top").alias("top"), F.sum("over").alias("over")],
        lambda u: F.struct(F.col("top").alias("maximum"), F.col("over").alias("n")),
    ),
}


def quantile_of(values: Col, q: float) -> Column:
    """Linear-interpolated quantile of an array."""
    s = F.array_sort(col(values))
    at = d(q) * (F.size(s) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return a + (b - a) * (at - low)


def window_states(samples: DataFrame, keys: list[str], methods: list[str], threshold: float = 0.9, x: str = "x") -> DataFrame:
    """States of windows under all methods, from one grouping; no two methods name a column alike."""
    return samples.groupBy(*keys).agg(*[c for m in methods for c in STATES[m][0](x, threshold)])


def merge_states(a: DataFrame, b: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """States of the same windows merged, as Spark's partial aggregation does between tasks."""
    return a.unionByName(b).groupBy(*keys).agg(*[c for m in methods for c in STATES[m][1]()])


def finish_states(states: DataFrame, keys: list[str], methods: list[str], threshold: float = 0.9) -> DataFrame:
    """(keys, a column per method); that of maximum_count has both, as (maximum, n)."""
    return states.select(*keys, *[STATES[m][2](threshold).alias(m) for m in methods])


#: Fixed values of the native sketch: relative accuracy, and bins after which the lowest collapse into one.
NATIVE_ERROR, MOST_BINS = 0.00775, 2048


def contiguous_store(rows: DataFrame, keys: list[str], most: int = MOST_BINS) -> DataFrame:
    """(keys, zeros, offset, counts) of sketch rows: counts of consecutive buckets from `offset` on, at most `most` of them.

    Lower buckets are collapsed into the lowest one kept. A sketch of zeros only has no buckets, and a null offset.
    """
    top = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("bucket") == ZERO_KEY, F.col("n")).otherwise(0)).alias("zeros"),
        F.min(F.when(F.col("bucket") != ZERO_KEY, F.col("bucket"))).alias("__lo"), F.max(F.when(F.col("bucket") != ZERO_KEY, F.col("bucket"))).alias("__hi"),
        F.collect_list(F.when(F.col("bucket") != ZERO_KEY, F.struct("bucket", "n"))).alias("__b"),
    )
    lo = F.greatest("__lo", F.col("__hi") - (most - 1))
    # Buckets of a window are few, or as many as `most` after collapsing.
    held = F.transform("__b", lambda b: F.struct(F.greatest(b["bucket"], F.col("offset")).alias("k"), b["n"].alias("n")))

    def count(at: Column) -> Column:
        return F.aggregate(F.filter(F.col("__h"), lambda b: b["k"] == at), F.lit(0).cast("bigint"), lambda acc, b: acc + b["n"])

    top = top.withColumn("offset", lo).withColumn("__h", held)
    counts = F.when(F.col("offset").isNotNull(), F.transform(F.sequence("offset", "__hi"), count)).otherwise(F.array().cast("array<bigint>"))
    return top.select(*keys, "zeros", "offset", counts.alias("counts"))


def varint_bytes(n: Col) -> Column:
    """Bytes of a non-negative number as a varint: seven bits each."""
    return sum((F.when(col(n) >= F.lit(1 << 7 * k), 1).otherwise(0) for k in range(1, 9)), F.lit(1))


def zigzag(n: Col) -> Column:
    """Signed to non-negative numbers, small ones first."""
    return F.when(col(n) >= 0, 2 * col(n)).otherwise(-2 * col(n) - 1)


def native_bytes(bins: Col, offset: Col, zeros: Col) -> Column:
    """Wire bytes of a native sketch: its mapping (one double), the store of positive values, and a count of zeros.

    Fields are tags of one byte before a double, a varint or a message with its length; zero fields are left out. The
    store has its counts as packed doubles and the offset as a signed varint.
    """
    message = lambda size: 1 + varint_bytes(size) + size
    store = F.when(col(bins) > 0, 1 + varint_bytes(8 * col(bins)) + 8 * col(bins)).otherwise(0)
    store = store + F.when(F.coalesce(col(offset), F.lit(0)) != 0, 1 + varint_bytes(zigzag(offset))).otherwise(0)
    return (F.lit(2 + 9) + message(store) + F.when(col(zeros) > 0, 9).otherwise(0)).cast("long")
