"""Histogram boosted trees for a binary target.

Features are binned once. Trees see bins only, so rows of equal bins keep equal scores through all rounds: they are
summed to cells of (bins, rows, positives) first, which are written as blocks of arrays. A level of a tree is one pass over
the blocks: each task sums gradients and Hessians per (node, feature, bin) with NumPy, and the sums are reduced in a tree of
tasks. Splits are searched by prefix sums over those few numbers; leaves are split best first, or level by level where
the number of leaves cannot bind. What reaches the driver is bounded by nodes, features and bins, never by rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalar import expit
from .scratch import written
from .selection import order_statistics

# Functions given to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 255
#: Trees between two writings of the cells' scores; until then tasks add the trees since.
KEPT = 10
MIN_HESSIAN = 1e-3


@dataclass
class Tree:
    """Nodes by number: the feature that splits it (-1: a leaf), the last bin that goes left, both children, a leaf's value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        for parts, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.depth, self.depth[node] + 1)):
            parts += [new, new]
        return a, a + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        """What leaf_of() reads, the values, and the depth."""
        parts = (self.feature, self.cut, self.left, self.right)
        return (*(np.array(x, np.int32) for x in parts), np.array(self.value), np.int32(max(self.depth)))


def leaf_of(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The leaves of rows by their bins (row, feature); tree: Tree.arrays()."""
    feature, cut, left, right, _, depth = tree
    at, rows = np.zeros(len(bins), np.int32), np.arange(len(bins))
    for _ in range(depth):
        of = feature[at]
        at = np.where(of < 0, at, np.where(bins[rows, of] <= cut[at], left[at], right[at]))
    return at


def summed(trees: list[tuple[np.ndarray, ...]], bins: np.ndarray, base: np.ndarray | float) -> np.ndarray:
    """base and the values of the rows' leaves."""
    out = np.zeros(len(bins)) + base
    for tree in trees:
        out += tree[4][leaf_of(tree, bins)]
    return out


@dataclass
class Boosted:
    names: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]

    def score(self, df: DataFrame) -> DataFrame:
        """df with p. Bins are one array column, so that no feature is binned twice."""
        base, trees, width = self.base, [t.arrays() for t in self.trees], len(self.names)

        @F.arrow_udf("double")
        def raw(bins: pa.Array) -> pa.Array:
            return pa.array(summed(trees, bins.flatten().to_numpy().reshape(-1, width), base))

        return df.withColumn("p", expit(raw(bins_of(self.names, self.edges)) if trees else F.lit(base)))


def bins_of(names: list[str], edges: list[list[float]]) -> Column:
    """array<int>: how many edges of its feature lie below each value, by binary search; null and NaN are in the first bin."""
    def below(x: Column, e: list[float]) -> Column:
        at, steps = F.lit(e), [1 << k for k in range(len(e).bit_length() - 1, -1, -1)]

        def step(lo: Column, by: Column) -> Column:
            return F.when((lo + by <= len(e)) & (F.get(at, lo + by - 1) < x), lo + by).otherwise(lo)

        return F.when(x.isNull() | F.isnan(x), 0).otherwise(F.aggregate(F.lit(steps), F.lit(0), step))

    return F.array(*[below(F.col(c).cast("double"), e) if e else F.lit(0) for c, e in zip(names, edges, strict=True)])


def bin_edges(train: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Edges of each feature: midpoints of its distinct values if there are at most `bins`, else its distinct quantiles."""
    long = train.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in names])).alias("f", "x")).where("x is not null and not isnan(x)")
    values = written(long.groupBy("f", "x").agg(F.count("*").alias("n")), "values")
    few = {r.f for r in values.groupBy("f").count().where(F.col("count") <= bins).collect()}
    out: list[list[float]] = [[] for _ in names]
    for f, x in sorted((r.f, r.x) for r in values.where(F.col("f").isin(list(few))).select("f", "x").collect()) if few else []:
        out[f].append(x)
    for f in few:
        out[f] = [(a + b) / 2 for a, b in zip(out[f], out[f][1:], strict=False)]
    rest = [f for f in range(len(names)) if f not in few]
    if rest:
        at = F.transform(F.lit([i / bins for i in range(1, bins)]), lambda q: (F.col("n") - 1) * q)
        ranks = F.concat(F.transform(at, lambda a: F.floor(a).cast("bigint")), F.transform(at, lambda a: F.ceil(a).cast("bigint")))
        for r in order_statistics(long.where(F.col("f").isin(rest)), ["f"], "x", ranks).collect():
            value = {v.rank: v.value for v in r.ranks}
            out[r.f] = sorted({_between(value, (r.n - 1) * (i / bins)) for i in range(1, bins)})
    return out


def _between(value: dict[int, float], at: float) -> float:
    """Linear interpolation between the places around `at`."""
    a, b = value[math.floor(at)], value[math.ceil(at)]
    return a if a == b else a + (b - a) * (at - math.floor(at))


def cells_of(train: DataFrame, names: list[str], edges: list[list[float]], target: str) -> DataFrame:
    """(bins, n, k): rows and positives of each combination of bins."""
    return train.select(bins_of(names, edges).alias("bins"), F.col(target).cast("long").alias("y")).groupBy("bins").agg(F.count("*").alias("n"), F.sum("y").alias("k"))


def blocks_of(cells: DataFrame, base: float) -> DataFrame:
    """(bins, n, k, raw): the arrays of an Arrow batch of cells, and their scores."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = batch.column(0).flatten().to_numpy().astype(np.int32)
                n, k = (batch.column(i).to_numpy().astype(np.float64) for i in (1, 2))
                arrays = (bins, n, k, np.full(len(n), base))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], ["bins", "n", "k", "raw"])

    return cells.select("bins", "n", "k").mapInArrow(pack, "bins binary, n binary, k binary, raw binary")


def _arrays(block: Row) -> tuple[np.ndarray, ...]:
    n, k, raw = (np.frombuffer(block[c]) for c in ("n", "k", "raw"))
    return np.frombuffer(block["bins"], np.int32).reshape(len(n), -1), n, k, raw


def advanced(blocks: DataFrame, trees: list[Tree]) -> DataFrame:
    """The blocks with the trees' values added to their scores."""
    since = [t.arrays() for t in trees]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = []
            for block in batch.to_pylist():
                bins, _, _, raw = _arrays(block)
                raws.append(summed(since, bins, raw).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raws, pa.binary())], batch.schema.names)

    return blocks.mapInArrow(add, blocks.schema)


def histograms(blocks: RDD[Row], trees: list[Tree], tree: Tree, nodes: list[int], sizes: list[int]) -> dict[int, dict[int, np.ndarray]]:
    """Per node of `tree` and feature (bin, (n, g, h)): rows, gradients and Hessians of the log loss; trees: those not yet in the scores."""
    since, own, edge = [t.arrays() for t in trees], tree.arrays(), np.cumsum([0, *sizes])
    width, place = int(edge[-1]), np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes))

    def count(part: Iterator[Row]) -> Iterator[np.ndarray]:
        total = np.zeros((3, len(nodes) * width))
        for block in part:
            bins, n, k, raw = _arrays(block)
            p = 1 / (1 + np.exp(-summed(since, bins, raw)))
            at = place[leaf_of(own, bins)]
            here = at >= 0
            code = (at[here, None] * width + edge[None, :-1] + bins[here]).ravel()
            for i, x in enumerate((n, n * p - k, n * p * (1 - p))):
                total[i] += np.bincount(code, np.repeat(x[here], len(sizes)), len(nodes) * width)
        yield total

    total = blocks.mapPartitions(count).treeReduce(np.add).reshape(3, len(nodes), width)
    return {n: {f: total[:, i, edge[f] : edge[f + 1]].T for f in range(len(sizes))} for i, n in enumerate(nodes)}


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    sides: tuple[np.ndarray, np.ndarray]


def gains(hist: np.ndarray, l2: float, least: int) -> np.ndarray:
    """Gain of a split after each bin but the last, -inf where a side has too few rows; hist: (bin, (n, g, h))."""
    left = np.cumsum(hist, 0)[:-1]
    whole = hist.sum(0)
    right = whole - left
    part = lambda s: s[..., 1] ** 2 / (s[..., 2] + l2)
    ok = (left[:, 0] >= least) & (right[:, 0] >= least) & (left[:, 2] >= MIN_HESSIAN) & (right[:, 2] >= MIN_HESSIAN)
    return np.where(ok, part(left) + part(right) - part(whole), -np.inf)


def best_split(hist: dict[int, np.ndarray], l2: float, least: int) -> Split | None:
    """The split of greatest gain; of equal ones that of the first feature and bin. Gains not above rounding are none."""
    best = None
    for f in sorted(hist):
        g = gains(hist[f], l2, least)
        if len(g) and g.max() > 1e-12 and (best is None or g.max() > best.gain + 1e-12):
            cut = int(np.argmax(g))
            left = hist[f][: cut + 1].sum(0)
            best = Split(float(g.max()), f, cut, (left, hist[f].sum(0) - left))
    return best


def grow(blocks: RDD[Row], trees: list[Tree], sizes: list[int], rate: float, l2: float, least: int, leaves: int, depth: int | None) -> Tree:
    """One tree on the cells' gradients; trees: those not yet in the blocks' scores."""
    tree, open_ = Tree(), {0: None}
    level = depth is not None and 2**depth <= leaves
    fresh, sums = [0], {}
    while True:
        for n, hist in (histograms(blocks, trees, tree, fresh, sizes) if fresh else {}).items():
            sums[n] = hist[0].sum(0)
            open_[n] = best_split(hist, l2, least)
        able = sorted((n for n, s in open_.items() if s), key=lambda n: (-open_[n].gain, n))
        able = able[: min(len(able) if level else 1, leaves - len(open_))]
        if not able:
            break
        fresh = []
        for n in able:
            s = open_.pop(n)
            both = tree.split(n, s.feature, s.cut)
            open_ |= dict.fromkeys(both)
            sums |= dict(zip(both, s.sides, strict=True))
            fresh += both
        # Sums of nodes that can't be split further are known from their parents' histograms.
        fresh = [n for n in fresh if (depth is None or tree.depth[n] < depth) and len(open_) < leaves]
    for n in open_:
        _, g, h = sums[n]
        tree.value[n] = float(-rate * g / (h + l2))
    return tree


def fit_boosted(
    train: DataFrame, names: list[str], target: str = "target", rounds: int = 200, rate: float = 0.05, l2: float = 1.0,
    least: int = 20, leaves: int = 31, depth: int | None = 3, bins: int = BINS,
) -> Boosted:
    """Minimise the log loss by `rounds` trees from the base rate's log odds; no early stop and nothing random.

    least: rows of a leaf; leaves, depth: of a tree. A null or NaN feature is in its first bin; without rows, or of one
    class only, the model is the (clipped) base rate.
    """
    edges = bin_edges(train, names, bins)
    cells = written(cells_of(train, names, edges, target), "cells")
    n, k = cells.agg(F.sum("n"), F.sum("k")).first()
    share = min(max((k or 0) / n, 1e-12), 1 - 1e-12) if n else 0.5
    model = Boosted(list(names), edges, float(np.log(share / (1 - share))), [])
    if not n or k in (0, n) or not names:
        return model
    blocks, since = written(blocks_of(cells, model.base), "blocks"), 0
    held = blocks.rdd
    for i in range(1, rounds + 1):
        tree = grow(held, model.trees[since:], [len(e) + 1 for e in edges], rate, l2, least, leaves, depth)
        model.trees.append(tree)
        if tree.feature[0] < 0:
            break  # no split is left, and none comes again
        if i % KEPT == 0:
            blocks, since = written(advanced(blocks, model.trees[since:]), "blocks"), i
            held = blocks.rdd
    return model


def root_gains(train: DataFrame, names: list[str], target: str = "target", l2: float = 1.0, least: int = 20, bins: int = BINS) -> DataFrame:
    """(feature, edge, rows_left, gain): every admissible split of the first round's root."""
    edges = bin_edges(train, names, bins)
    cells = written(cells_of(train, names, edges, target), "cells")
    n, k = cells.agg(F.sum("n"), F.sum("k")).first()
    rows = []
    if n and 0 < k < n:
        blocks = blocks_of(cells, float(np.log(k / (n - k)))).rdd
        for f, h in histograms(blocks, [], Tree(), [0], [len(e) + 1 for e in edges])[0].items():
            left = np.cumsum(h[:, 0])
            rows += [(names[f], edges[f][b], int(left[b]), float(g)) for b, g in enumerate(gains(h, l2, least)) if g > -np.inf]
    return train.sparkSession.createDataFrame(rows, "feature string, edge double, rows_left long, gain double")
