"""Ranges, selection, boosted trees and repeats over keys of any size, against pandas and NumPy."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sketch
from tidemark.operators import boosting, clean, metrics, models, ranges, selection


@pytest.fixture(scope="module")
def hot(spark):
    """Four keys, one of them null and one with most rows."""
    rng = np.random.default_rng(1)
    n = 4000
    wide = rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n)
    pdf = pd.DataFrame({
        "k": rng.choice(["a", "b", "c", "-"], n, p=[0.7, 0.2, 0.05, 0.05]), "o": rng.permutation(n), "v": rng.integers(0, 9, n),
        "x": np.where(rng.random(n) < 0.3, rng.integers(-5, 5, n).astype(float), wide),
    })
    return pdf, spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "-", F.col("k")))


def test_places_sums_and_totals(hot):
    pdf, df = hot
    got = ranges.placed(df, ["k"], ["o"], sums={"s": F.col("v")}, totals={"t": F.col("v")}).toPandas()
    want = pdf.sort_values("o")
    g = want.groupby("k")
    want = want.assign(i=g.cumcount(), n=g["v"].transform("size"), s=g["v"].cumsum(), t=g["v"].transform("sum"))
    both = want.merge(got, on="o")
    assert len(both) == len(pdf) and all((both[f"{c}_x"] == both[f"{c}_y"]).all() for c in ("i", "n", "s", "t"))


def test_places_without_keys_descending_and_of_nothing(hot):
    _, df = hot
    assert ranges.placed(df, [], [F.col("o").desc()]).where(F.col("i") + F.col("o") != 3999).count() == 0
    assert ranges.placed(df.limit(0), ["k"], ["o"]).count() == 0


def test_one_key_spans_many_tasks(hot):
    _, df = hot
    parts = ranges.placed(df.where("k = 'a'"), ["k"], ["o"], parts=8, keep=True).groupBy(ranges.PART).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * 2800 / 8


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_equal_those_of_one_buffer(hot, keys):
    _, df = hot
    shares = {f"q{n}": q for n, q in enumerate((0, 0.001, 0.25, 0.5, 0.99, 1))}
    odd = df.withColumn("x", F.when(F.col("o") % 50 == 0, None).otherwise(F.col("x")))
    got = sorted(map(tuple, selection.quantiles(odd, keys, "x", shares).collect()), key=str)
    want = sorted(map(tuple, odd.groupBy(*keys).agg(*[F.percentile("x", q).alias(c) for c, q in shares.items()]).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[: len(keys)] == b[: len(keys)] and np.allclose(a[len(keys) :], b[len(keys) :], rtol=1e-12, atol=0)


def test_quantiles_of_zeros_infinities_and_nothing(spark):
    df = spark.createDataFrame([(1, 0.0), (1, -0.0), (1, float("inf")), (1, float("-inf")), (2, None)], "k int, x double")
    got = selection.quantiles(df, ["k"], "x", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()
    assert [tuple(r) for r in got] == [(1, float("-inf"), 0.0, float("inf"))]
    assert selection.quantiles(df.limit(0), ["k"], "x", {"q": 0.5}).count() == 0


def test_average_precision_over_one_group_of_distinct_scores(spark):
    rng = np.random.default_rng(3)
    p, y = rng.random(2000), rng.integers(0, 2, 2000)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "target": y}))
    order = np.argsort(-p)
    tp = np.cumsum(y[order])
    want = (tp / np.arange(1, 2001))[y[order] == 1].mean()
    assert abs(metrics.average_precision(df, []).first()[0] - want) < 1e-12
    wins = sum((p[y == 0] < a).sum() for a in p[y == 1]) / ((y == 1).sum() * (y == 0).sum())
    assert abs(metrics.roc_auc(df, []).first()[0] - wins) < 1e-12


# Boosted trees by NumPy, row by row: the same objective, without cells or histograms of nodes.


def numpy_boosted(x, y, edges, rounds, rate, l2, least, leaves, depth):
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)  # noqa: B023, E731

        def best(rows, deep):
            found = None
            for f in range(x.shape[1]) if depth is None or deep < depth else ():
                for b in range(len(edges[f])):
                    a, c = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    if min(len(a), len(c)) < least or min(h[a].sum(), h[c].sum()) < boosting.MIN_HESSIAN:  # noqa: B023
                        continue
                    gain = part(a) + part(c) - part(rows)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, a, c)
            return found

        open_ = [(np.arange(len(y)), 0)]
        found = [best(*open_[0])]
        while len(open_) < leaves and any(found):
            at = max((k for k in range(len(open_)) if found[k]), key=lambda k: found[k][0])
            (_, a, c), (_, deep) = found.pop(at), open_.pop(at)
            open_ += [(a, deep + 1), (c, deep + 1)]
            found += [best(a, deep + 1), best(c, deep + 1)]
        for rows, _ in open_:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize(("leaves", "depth", "bins"), [(31, 3, 255), (5, None, 12), (5, 3, 255)])
def test_boosted_trees_equal_numpy(spark, leaves, depth, bins):
    rng = np.random.default_rng(11)
    x = np.stack([rng.integers(0, 9, 400), rng.normal(size=400).round(2), rng.integers(0, 2, 400)], 1).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 4 + 2 * x[:, 1] * (x[:, 2] - 0.5))))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "target": y}))
    m = boosting.fit_boosted(df, ["a", "b", "c"], rounds=12, rate=0.2, least=10, leaves=leaves, depth=depth, bins=bins)
    want = numpy_boosted(x, y, [np.array(e) for e in m.edges], 12, 0.2, 1.0, 10, leaves, depth)
    got = m.score(df).toPandas()
    assert np.abs(got["p"].to_numpy() - want).max() < 1e-9 and len(m.trees) == 12
    assert max(len(t.feature) for t in m.trees) <= 2 * min(leaves, 8 if depth else leaves) - 1


def test_a_level_of_a_boosted_tree_is_one_stage(spark):
    """Rounds neither shuffle nor aggregate rows: three stages a tree of depth 3, whatever the trees before it."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)).round(1)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "target": (x.sum(1) + rng.normal(size=300) > 0).astype(int)}))

    def stages(rounds):
        before = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
        assert len(boosting.fit_boosted(df, ["a", "b"], rounds=rounds, least=5).trees) == rounds
        return spark.sparkContext._jsc.sc().dagScheduler().nextStageId() - before

    assert stages(9) - stages(3) == 18


def test_boosted_trees_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 0), (1.0, 1), (2.0, 0)], "a double, target int")
    m = boosting.fit_boosted(df, ["a"], rounds=2, least=1)
    assert m.score(df).where("p is null or isnan(p)").count() == 0
    one = boosting.fit_boosted(df.where("target = 1"), ["a"])
    assert not one.trees and one.score(df).where("p < 0.999").count() == 0
    assert boosting.fit_boosted(df.limit(0), ["a"]).score(df).first()["p"] == 0.5


def kept_one_by_one(rows, within):
    last, out = {}, []
    for k, s, t, p in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        old = last.get(k)
        if old and old[1] == p and t is not None and old[0] is not None and 0 <= t - old[0] <= within:
            continue
        last[k] = (t, p)
        out.append((k, s))
    return sorted(out, key=str)


@pytest.mark.parametrize("backward", [False, True])
def test_short_repeats(spark, backward):
    rng = np.random.default_rng(5)
    rows, t = [], 0
    for s in range(1500):
        t += int(rng.choice([0, 1, 30, 100, 179, 180, 181, 400], p=[0.1, 0.2, 0.4, 0.2, 0.03, 0.03, 0.02, 0.02]))
        rows.append((["a", "b", None][int(rng.choice([0, 1, 2], p=[0.8, 0.1, 0.1]))], s, t - (int(rng.integers(0, 300)) if backward and s % 9 == 0 else 0), "x" if rng.random() < 0.97 else "y"))
    rows += [("idle", s, 60 * s, None) for s in range(700)]
    df = spark.createDataFrame(rows, "k string, s long, t long, p string")
    got = sorted(map(tuple, clean.drop_short_repeats(df, ["k"], "s", "t", "p", 180).collect()), key=str)
    assert got == kept_one_by_one(rows, 180)


def test_calibration_fits_that_fail(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + 2 * z)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": 1 / (1 + np.exp(-z)), "target": y}))
    m = models.calibration_fit(df)
    mu = 1 / (1 + np.exp(-(m.intercept + m.slope * z)))
    assert m.state == "converged" and abs((mu - y).sum()) < 1e-6 and abs(((mu - y) * z).sum()) < 1e-6
    apart = df.withColumn("p", F.when(F.col("target") == 1, 0.9).otherwise(0.2))
    assert models.calibration_fit(apart) == models.Line("separated") and models.calibration_line(apart) == (None, None)
    assert models.calibration_fit(df.where("target = 1")).state == "separated"
    assert models.calibration_fit(df.withColumn("p", F.lit(0.3))).state == "constant" and models.calibration_fit(df.limit(0)).state == "constant"
    wide = df.withColumn("p", F.when(F.col("p") < 0.2, 0.0).when(F.col("p") > 0.8, 1.0).otherwise(F.col("p")))
    assert {models.calibration_fit(wide, eps=e).state for e in (1e-6, 1e-8, 2.2e-16)} == {"converged"}


def test_generated_windows(spark):
    from tidemark.sources import readers

    x = readers.beta_windows(spark, 2500, block=1000)
    r = x.agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.avg((F.col("x") >= 0.9).cast("double")).alias("b"), F.count_distinct("window_id").alias("w")).first()
    assert (r.n, r.w) == (30_000, 2500) and abs(r.m - (0.975 * 2 / 9 + 0.025 * 0.95)) < 0.01 and abs(r.b - 0.025) < 0.005


def encoded(values, error, most):
    """A sketch's bytes, field by field."""
    gamma = (1 + error) / (1 - error)
    keys = [math.ceil(math.log(v) / math.log(gamma)) for v in values if v > 0]

    def varint(n):
        out = b""
        while n >= 128:
            out, n = out + bytes((n % 128 + 128,)), n // 128
        return out + bytes((n,))

    field = lambda tag, body: bytes((tag,)) + varint(len(body)) + body
    store, counts = b"", []
    if keys:
        low = max(min(keys), max(keys) - most + 1)
        counts = [sum(max(k, low) == at for k in keys) for at in range(low, max(keys) + 1)]
        store = field(0x12, b"".join(struct.pack("<d", c) for c in counts))
        store += b"\x18" + varint(2 * low if low >= 0 else -2 * low - 1) if low else b""
    zeros = len(values) - len(keys)
    return field(0x0A, b"\x09" + struct.pack("<d", gamma)) + field(0x12, store) + (b"\x21" + struct.pack("<d", zeros) if zeros else b""), counts


@pytest.mark.parametrize("most", [2048, 40])
def test_native_sketch_has_the_size_of_its_encoding(spark, most):
    rng = np.random.default_rng(6)
    sets = [[0.0] * 3, [1.0] * 12, [0.0, 1.0], [1e-9, 1.0], [50.0, 60.0], [1e-30, 1e30]] + [list(rng.gamma(2, 10.0 ** rng.integers(-3, 3), 12)) for _ in range(60)]
    df = spark.createDataFrame([(i, float(v)) for i, s in enumerate(sets) for v in s], "w long, x double")
    rows = sketch.sketch_rows(df, ["w"], error=sketch.NATIVE_ERROR)
    got = sketch.contiguous_store(rows, ["w"], most).withColumn("bins", F.size("counts").cast("long"))
    for r in got.withColumn("bytes", sketch.native_bytes("bins", "offset", "zeros")).collect():
        body, counts = encoded(sets[r.w], sketch.NATIVE_ERROR, most)
        assert list(r.counts) == counts and r.bytes == len(body) and len(counts) <= most


def test_exact_split_has_exact_sizes_and_depends_on_the_seed(spark):
    from tidemark.operators import features

    ids = spark.createDataFrame([(i % 97,) for i in range(300)] + [(None,)], "e long")
    one, same, other = ({r.e: r.split for r in features.exact_split(ids, "e", s).collect()} for s in (1, 1, 2))
    assert one == same != other and set(one) == set(range(97)) and list(one.values()).count("train") == int(0.7 * 97)
    assert features.exact_split(ids.limit(0), "e", 1).count() == 0
