"""Transitions to the next window, leakage-free splits, feature families and priors."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col, core_feature, cut_index, d, flag, smoothed_rate
from . import ranges
from .selection import quantiles

#: Least windows of an entity, and least transitions for training and test.
MIN_WINDOWS, MIN_TRAIN, MIN_TEST = 50, 20, 5
TRAIN_SHARE = 0.7


def transitions(blocks: DataFrame, keys: list[str], event: str = "event", keep: bool = False) -> DataFrame:
    """Each window with ord, the entity's number of windows nw, and target: the event of the very next window.

    Places come from range partitions, and the next window from a join on its number, so an entity may have any number
    of windows; rows without a contiguous successor go. keep: leave the columns of ranges.totals_by_part().
    """
    t = ranges.placed(blocks, keys, ["window_id"], keep=True).withColumnsRenamed({"i": "ord", "n": "nw"})
    following = t.select(*keys, (F.col("window_id") - 1).alias("window_id"), F.col(event).alias("target"))
    t = ranges.joined(t, following, [*keys, "window_id"])
    return t if keep else t.drop(ranges.PART, ranges.AT)


def temporal_split(
    blocks: DataFrame, keys: list[str], event: str = "event", share: float = TRAIN_SHARE, windows: int = MIN_WINDOWS,
    train: int = MIN_TRAIN, test: int = MIN_TEST,
) -> DataFrame:
    """transitions() with split: the target's window decides, and entities with few rows on a side go."""
    t = transitions(blocks, keys, event, keep=True).where(F.col("nw") >= windows)
    t = t.withColumn("split", F.when(F.col("ord") + 1 < cut_index("nw", share), "train").otherwise("test"))
    sides = {f"__{s}": (F.col("split") == s).cast("long") for s in ("train", "test")}
    t = ranges.totals_by_part(t, keys, sides).where((F.col("__train") >= train) & (F.col("__test") >= test))
    return t.drop("__train", "__test", ranges.PART, ranges.AT)


def ordered_split(pairs: DataFrame, keys: list[str], share: float = TRAIN_SHARE, least: int = MIN_TRAIN) -> DataFrame:
    """Split of transitions themselves, cut at max(least, int(share * transitions))."""
    t = ranges.placed(pairs, keys, ["window_id"])
    cut = F.greatest(F.lit(least), cut_index("n", share))
    return t.withColumn("split", F.when(F.col("i") < cut, "train").otherwise("test")).drop("i", "n")


def disjoint_entities(entities: list, seed: int, share: float = TRAIN_SHARE) -> tuple[list, list]:
    """A seeded shuffle of the entities' sorted ids, for training and for test."""
    s = sorted(entities)
    random.Random(seed).shuffle(s)
    cut = int(share * len(s))
    return sorted(s[:cut]), sorted(s[cut:])


def disjoint_split(pairs: DataFrame, entity: str, share: float = TRAIN_SHARE) -> DataFrame:
    """Entity-disjoint split by a digest of the id: no list of entities is collected, and it is the same in any engine."""
    part = F.conv(F.substring(F.md5(F.col(entity).cast("string")), 1, 8), 16, 10).cast("long") % 1000
    return pairs.withColumn("split", F.when(part < int(share * 1000), "train").otherwise("test"))


def exact_split(entities: DataFrame, entity: str, seed: int, share: float = TRAIN_SHARE) -> DataFrame:
    """(entity, split): a seeded shuffle of the distinct entities, of which exactly int(share * entities) train.

    The shuffle orders entities by a digest of seed and id, ties by id; places come from range partitions, so no list of
    entities is collected or sorted in one task, and any engine shuffles alike. A null is no entity.
    """
    e = entities.where(F.col(entity).isNotNull()).select(entity).distinct()
    e = e.withColumn("__d", F.md5(F.concat(F.lit(f"{seed}-"), F.col(entity).cast("string"))))
    e = ranges.placed(e, [], ["__d", entity])
    return e.select(entity, F.when(F.col("i") < cut_index("n", share), "train").otherwise("test").alias("split"))


def _with_flag(v: str, u: float) -> list[Column]:
    return [F.col(v), flag(F.col(v) >= d(u)).cast("double")]


def features(family: str, scheme: str, u: float = 1.0, m: int = 12) -> list[Column]:
    """Feature columns f0, f1, ... of a scheme. Families share names of schemes, not their columns.

    The blocks hold snapshot, snapshot_late, mean, p95, maximum, cnt and event; `offset` models add a panel's prior.
    """
    q = F.col("cnt") / float(m)
    late = flag(F.col("snapshot") >= d(u)).cast("double") + flag(F.col("snapshot_late") >= d(u)).cast("double")
    seen = late / 2
    pair = [F.col("snapshot"), F.col("snapshot_late"), F.greatest("snapshot", "snapshot_late"), seen]
    top = flag(F.col("maximum") >= d(u)).cast("double")
    event = [F.col("event").cast("double")]
    table = {
        "offset": {
            "snapshot": _with_flag("snapshot", u), "mean": _with_flag("mean", u), "p95": _with_flag("p95", u),
            "maximum": _with_flag("maximum", u), "two_snapshots": [*pair, flag(seen > 0).cast("double")],
            "maximum_count": [F.col("maximum"), q, top],
        },
        "multi": {
            "persistence": event, "snapshot": _with_flag("snapshot", u), "two_snapshots": pair,
            "maximum": [F.col("maximum")], "count": [q], "maximum_count": [F.col("maximum"), q, top],
        },
        "ablation": {
            "persistence": event, "snapshot": [F.col("snapshot")], "two_snapshots": pair[:2], "maximum": [F.col("maximum")],
            "count": [q], "maximum_event": [F.col("maximum"), top], "maximum_count": [F.col("maximum"), q],
            "full": [F.col("maximum"), q, top],
        },
        "external": {
            "prior": [], "persistence": event, "snapshot": _with_flag("snapshot", u), "two_snapshots": pair,
            "maximum": [F.col("maximum")], "count": [q], "maximum_count": [F.col("maximum"), q], "full": [F.col("maximum"), q, top],
        },
        "disjoint": {"maximum_count": [F.col("maximum"), q, top, core_feature("cores")]},
    }
    return [c.cast("double").alias(f"f{i}") for i, c in enumerate(table[family][scheme])]


def leaky_snapshot_threshold(pairs: DataFrame, q: float = 0.95) -> DataFrame:
    """Quantile of `maximum` over all transitions, test included: only for comparison with results made so."""
    return quantiles(pairs, [], "maximum", {"threshold": q})


def priors(split: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """(keys, k, n, rate): smoothed event rates of the training rows."""
    r = split.where("split = 'train'").groupBy(*keys).agg(F.sum(target).alias("k"), F.count("*").alias("n"))
    return r.withColumn("rate", smoothed_rate("k", "n"))


def with_prior(split: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """split with its key's training rate as `prior`, the global one where a key has no training rows."""
    whole = split.where("split = 'train'").agg(smoothed_rate(F.sum(target), F.count("*")).alias("__all"))
    out = split.join(priors(split, keys, target).select(*keys, "rate"), keys, "left").join(F.broadcast(whole))  # one row
    return out.withColumn("prior", F.coalesce("rate", "__all")).drop("rate", "__all")


def standardise(split: DataFrame, names: list[str], floor: float = 1e-8) -> DataFrame:
    """Columns scaled by the training rows' mean and population deviation; a deviation under the floor counts 1."""
    of = split.where("split = 'train'").agg(
        *[F.avg(c).alias(f"__m_{c}") for c in names], *[F.stddev_pop(c).alias(f"__s_{c}") for c in names]
    )
    s = lambda c: F.when(col(f"__s_{c}") < d(floor), d(1)).otherwise(col(f"__s_{c}"))
    out = split.join(F.broadcast(of))  # one row by construction
    return out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / s(c) for c in names}).drop(*of.columns)
