"""Operators on small cases whose results can be computed by hand, and against plain Python loops."""

import hashlib
import itertools
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar, sketch
from tidemark.operators import bootstrap, clean, features, fidelity, metrics, models, policy, windows
from tidemark.sources import readers


def collect(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_only_complete_windows_stay(spark):
    hours = {0: 11, 1: 12, 2: 13}
    df = spark.createDataFrame([(3600 * h + 60 * k, k, 0.5) for h, n in hours.items() for k in range(n)], "t long, seq long, x double")
    assert collect(windows.summarise(windows.calendar(df, [], "t", ["seq"], 3600), [], 12), "window_id") == [(1,)]


def test_a_duplicate_fills_a_gap(spark):
    df = spark.createDataFrame([(60 * k, k, 0.5) for k in range(11)] + [(0, 99, 0.5)], "t long, seq long, x double")
    assert windows.summarise(windows.calendar(df, [], "t", ["seq"], 3600), [], 12).count() == 1


def test_exact_repeats(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate("AABA")], "seq long, p string")
    assert collect(clean.drop_exact_repeats(df.withColumn("k", F.lit(1)), ["k"], ["seq"], "p"), "seq") == [(0,), (2,), (3,)]


def test_short_repeats_follow_the_kept_row(spark):
    rng, rows, want = random.Random(4), [], []
    for key in range(40):
        t, last = 0, None
        for seq in range(45):
            t += rng.choice([-50, 30, 90, 200])
            p = rng.choice("AB")
            rows.append((key, seq, t, p))
            if not (last and last[1] == p and 0 <= t - last[0] <= 180):
                want.append((key, seq))
                last = (t, p)
    df = spark.createDataFrame(rows, "k long, seq long, t long, p string")
    assert collect(clean.drop_short_repeats(df, ["k"], "seq", "t", "p"), "k", "seq") == want
    three = spark.createDataFrame([(1, i, t, "A") for i, t in enumerate((0, 100, 200))], "k long, seq long, t long, p string")
    assert collect(clean.drop_short_repeats(three, ["k"], "seq", "t", "p"), "seq") == [(0,), (2,)]


def test_last_row_of_a_time_stays_only_with_several_files(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 2), (1, 0, 1, 2.0, 2), (2, 0, 0, 1.0, 1), (2, 0, 1, 2.0, 1)], "k long, t long, seq long, x double, files long")
    assert collect(clean.keep_last(df, ["k"], "t", ["seq"], "files"), "k", "x") == [(1, 2.0), (2, 1.0), (2, 2.0)]


def test_ratio_bounds(spark):
    df = spark.createDataFrame([(1.000001,), (1.00001,), (-0.1,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(clean.valid_ratio("x")).collect()] == [True, False, False, False, False, False]


def test_capacity_zero_has_no_ratio(spark):
    assert spark.createDataFrame([(5.0, 0.0)], "u double, c double").select(clean.used_ratio("u", "c")).first()[0] is None


def test_no_positive_training_value_gives_threshold_one(spark):
    df = clean.in_order(spark.createDataFrame([(1, i, 0.0 if i < 8 else 5.0) for i in range(10)], "k long, s long, x double"), ["k"], ["s"], keep=True)
    assert {r.threshold for r in clean.normalise_bursts(df, ["k"]).collect()} == {1.0}


def test_cut_index_is_pythons(spark):
    df = spark.range(50, 2000).select("id", scalar.cut_index("id", 0.7).alias("c"))
    assert all(r.c == int(0.7 * r.id) for r in df.collect())


def test_expected_recall_of_samples(spark):
    blocks = spark.createDataFrame([(5,), (1,), (12,)], "cnt long")
    r = fidelity.random_sample_recall(blocks, []).first()
    seen = [[i < c or j < c for i in range(12) for j in range(12) if i != j] for c in (5, 1, 12)]
    assert abs(r.recall_one - np.mean([5, 1, 12]) / 12) < 1e-12 and abs(r.recall_two - np.mean(seen)) < 1e-12


def test_best_budget_maximises_capture(spark):
    rng = random.Random(12)
    p = [rng.choice([0.25, 0.5, 0.75]) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(p)), "i long, p double")
    got = sorted(r.i for r in metrics.best_budget(df, 7, ["i"]).collect())
    assert got == sorted(sorted(range(30), key=lambda i: (-p[i], i))[:7])


def test_persistence_rates(spark):
    r = fidelity.persistence_rates(spark.createDataFrame([(75, 25, 1, 3)], "n00 long, n01 long, n10 long, n11 long")).first()
    assert (r.p0, r.p1, r.risk_ratio) == (0.25, 0.75, 3.0)


def test_log_key_of_threshold(spark):
    r = spark.range(1).select(sketch.bucket_key(F.lit(0.9)).alias("k"), sketch.bucket_value(sketch.bucket_key(F.lit(0.9))).alias("v"), sketch.bucket_key(F.lit(0.0)).alias("z")).first()
    assert r.k == -5 and abs(r.v - 0.8957861) < 1e-6 and r.z == sketch.ZERO_KEY


def test_payload_sizes(spark):
    r = spark.range(1).select(sketch.payload_bytes("maximum_count").alias("m"), sketch.payload_bytes("raw").alias("r"), sketch.payload_bytes("snapshot").alias("s")).first()
    assert (r.m, r.r, r.s) == (24, 108, 20)


def test_ntile_sizes(spark):
    df = spark.range(23).select(F.lit(1).alias("k"), (F.col("id") / 23).alias("p"), (F.col("id") % 2).alias("target"), "id")
    assert [r.rows for r in metrics.reliability_bins(df, ["k"], ["id"]).orderBy("bin").collect()] == [3, 3, 3] + [2] * 7


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(5)
    p, y = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(p, y)], "k long, p double, target long")
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert abs(metrics.roc_auc(df, ["k"]).first().roc_auc - auc) < 1e-12
    ap = sum(((p == s) & (y == 1)).sum() * y[p >= s].mean() for s in np.unique(p)) / y.sum()
    assert abs(metrics.average_precision(df, ["k"]).first().average_precision - ap) < 1e-12
    edge = np.digitize(p, np.arange(1, 10) / 10, right=True)
    ece = sum((edge == b).sum() * abs(p[edge == b].mean() - y[edge == b].mean()) for b in np.unique(edge)) / len(p)
    assert abs(metrics.calibration_error(df, ["k"]).first().ece_10 - ece) < 1e-12


def test_newton_reaches_the_penalised_optimum(spark):
    rng = np.random.default_rng(3)
    x, o = rng.normal(size=(200, 2)), rng.normal(size=200) / 2
    y = (rng.random(200) < 1 / (1 + np.exp(-(o + x @ [1.0, -0.5])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), float(d)) for (a, b), c, d in zip(x, y, o)], "a double, b double, target long, o double")
    m = models.fit_logistic(df, ["a", "b"], offset="o")
    z = (x - x.mean(0)) / x.std(0)
    p = 1 / (1 + np.exp(-(o + m.intercept + z @ m.coefficients)))
    assert abs((p - y).sum()) < 1e-5 and np.abs(z.T @ (p - y) + m.coefficients).max() < 1e-5
    scored = df.select(m.score(["a", "b"], F.col("o")).alias("p")).collect()
    assert np.allclose(sorted(r.p for r in scored), sorted(p))


def test_queue_against_a_loop(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for key in range(20):
        a = np.sort(rng.uniform(0, 50, 30))
        free = [0.0] * 3
        for k, t in enumerate(a):
            i = free.index(min(free))
            free[i] = max(free[i], t) + 4.0
            want[key, k] = free[i] - t
        rows += [(key, k, float(t)) for k, t in enumerate(a)]
    df = policy.queue_latency(spark.createDataFrame(rows, "key long, k long, a double"), ["key"], 3, 4.0)
    assert all(abs(r.latency - want[r.key, r.k]) < 1e-9 for r in df.collect())


def test_hysteresis_against_a_loop(spark):
    rng, rows, want = random.Random(1), [], {}
    for key in range(50):
        on, lows = 0, 0
        for e in range(20):
            v = rng.random()
            high, low = v >= 0.7, v < 0.4
            lows = lows + 1 if low else 0
            on = 1 if high else 0 if lows >= 2 else on
            rows.append((key, e, v))
            want[key, e] = on
    df = spark.createDataFrame(rows, "key long, epoch long, v double")
    got = policy.hysteresis(df, ["key"], F.col("v") >= 0.7, F.col("v") < 0.4).collect()
    assert all(r.active == want[r.key, r.epoch] for r in got)


def test_hysteresis_takes_names_it_uses_itself(spark):
    df = spark.createDataFrame([(1, 0, 0.9)], "key long, epoch long, high double")
    assert policy.hysteresis(df, ["key"], F.col("high") > 0.5, F.col("high") < 0.2).first().active == 1


def test_block_draws_cover_each_series(spark):
    series = spark.range(57).select(F.when(F.col("id") < 40, "a").otherwise("b").alias("k"), F.col("id").alias("t"))
    numbered, drawn = bootstrap.block_multiplicities(series, "k", "t", 3)
    assert {(r.k, r.rep, r.n) for r in drawn.groupBy("k", "rep").agg(F.sum("times").alias("n")).collect()} == {("a", i, 40) for i in range(3)} | {("b", i, 17) for i in range(3)}
    assert numbered.where("k = 'b'").agg(F.max("at")).first()[0] == 16 and drawn.where("k = 'b' and at > 16").count() == 0


def test_one_to_one_fails_on_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "k long")
    with pytest.raises(Exception, match="one to one"):
        clean.one_to_one(a, a.distinct(), ["k"]).collect()
    assert clean.one_to_one(a.distinct(), a.distinct(), ["k"]).count() == 1


def test_sign_test():
    assert abs(metrics.sign_test(9, 10) - 22 / 1024) < 1e-12 and metrics.sign_test(5, 10) == 1.0


def test_disjoint_entities_share_nothing():
    a, b = features.disjoint_entities(list(range(100)), 20260727)
    assert len(a) == 70 and not set(a) & set(b) and sorted(a + b) == list(range(100))


def test_sample_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    head = ";".join(f"h{i}" for i in range(11))
    (tmp_path / "a/7.csv").write_text(f"{head}\n0; 2;x;x;50;10;5;1;2;3;4\n300;2;x;x;bad;10;5;1;2;3;4\n600;2\n")
    (tmp_path / "a/x.csv").write_text(f"{head}\n0;2;x;x;50;10;5;1;2;3;4\n")
    r = readers.read_samples(spark, str(tmp_path))
    assert collect(r, "entity", "t", "cpu_percent") == [(7, 0.0, 50.0), (7, 300.0, None), (7, 600.0, None)]
    assert collect(readers.entity_files(r), "entity", "files") == [(7, 1)]
    with pytest.raises(Exception, match="entities"):
        readers.expect_entities(r, 2).collect()


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("1.csv", "0;\t2;\ta;\tb;\t50;\tz\nshort;\t1\n")
    lines = readers.read_zip(spark, str(tmp_path / "s.zip"))
    assert collect(readers.read_lines(lines), "t", "cores", "cpu") == [(0.0, 2.0, 50.0)]


def test_external_series_cache_and_manifest(spark, tmp_path):
    (tmp_path / "e.csv").write_text("cpu\n50\nbad\n25\n")
    e = readers.read_external(spark, str(tmp_path / "e.csv"), "cpu", 100.0)
    assert sorted(r.x for r in e.collect()) == [0.25, 0.5]
    calls = []
    build = lambda: calls.append(1) or e
    for _ in range(2):
        assert readers.cached_table(spark, str(tmp_path / "t"), build).count() == 2
    assert len(calls) == 1
    found = readers.inventory(spark, str(tmp_path), "e.csv").first()
    readers.verify_sha256(spark, str(tmp_path / "e.csv"), found.sha256)
    with pytest.raises(ValueError):
        readers.verify_sha256(spark, str(tmp_path / "e.csv"), "0")
    readers.write_csv(e.select("x"), str(tmp_path / "csv"))
    assert sorted(r.x for r in spark.read.option("header", True).schema("x double").csv(str(tmp_path / "csv")).collect()) == [0.25, 0.5]
    readers.write_summary(e.where("x = 0.5").selectExpr("x as b", "'t' as a"), str(tmp_path / "json"))
    assert [r.value for r in spark.read.text(str(tmp_path / "json")).collect()] == ['{"a": "t", "b": 0.5}']


def test_stream_emits_closed_windows_once_and_drops_late_rows(spark, tmp_path):
    import datetime as dt
    import os
    import time

    from tidemark.streaming import windows as streaming

    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    (tmp_path / "in").mkdir()
    # A watermark bears on late rows from the second batch after it on.
    batches = [[(at(1), 5.0), (at(2), 50.0)], [(at(130), 1.0)], [(at(131), 1.0)], [(at(3), 99.0), (at(132), 2.0)], [(at(300), 1.0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        part = next((tmp_path / f"w{n}").glob("*.parquet"))
        os.utime(part, (time.time() - 100 + n,) * 2)
        part.rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = streaming.window_states(stream, "ts", "value", 3600, 30.0)
    streaming.run_available(states, lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), "append", str(tmp_path / "log"))
    got = sorted((r.rows, r.maximum, r.cnt) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(2, 50.0, 1), (3, 2.0, 0)]


def test_delayed_search_against_a_loop(spark):
    rng, rows, keys = random.Random(4), [], {}
    for key in range(12):
        keys[key] = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(20)]
        rows += [(key, e, p, y, 15) for e, (p, y) in enumerate(keys[key])]
    df = spark.createDataFrame(rows, "key long, epoch long, p double, target long, train long")
    for kind in ("predictive", "hybrid"):
        for h in (1, 3):
            got = {r.key: (round(r.cost, 9), round(r.action_rate, 9), round(r.threshold, 9)) for r in policy.search_delayed(df, ["key"], h, 10.0, kind).collect()}
            for key, series in keys.items():
                tried = []
                for q in {0.0, 1.0, *np.quantile([p for p, _ in series[: 15 - h]], policy.GRID).tolist()}:
                    on, lows, dec = False, 0, []
                    for p, y in series[:15]:
                        high = p >= q or (kind == "hybrid" and y == 1)
                        lows = 0 if high or p >= 0.7 * q else lows + 1
                        on = high or (kind == "hybrid" and on and lows < 2)
                        dec.append(on)
                    act, y = [dec[e - h] for e in range(h, 15)], [y for _, y in series[h:15]]
                    tried.append((round(10 * np.mean([t and not a for t, a in zip(y, act)]) + np.mean(act), 9), round(np.mean(act), 9), round(q, 9)))
                assert got[key] == min(tried)


def test_queue_against_a_heap(spark):
    import heapq

    rng = random.Random(8)
    arrivals = [(key, k, a) for key in range(6) for k, a in enumerate(sorted(rng.randint(0, 11) * 1.0 for _ in range(30)))]
    df = spark.createDataFrame(arrivals, "key long, k long, a double")
    for servers in (2, 5):
        free, want = {}, {}
        for key, k, a in arrivals:
            own = free.setdefault(key, [0.0] * servers)
            done = max(a, heapq.heappop(own)) + 1.5
            heapq.heappush(own, done)
            want[key, k] = done - a
        assert all(abs(r.latency - want[r.key, r.k]) < 1e-9 for r in policy.queue_latency(df, ["key"], servers, 1.5).collect())


def test_short_repeats_against_a_loop(spark):
    rng, rows, want = random.Random(2), [], set()
    for key in range(20):
        t, last = 0, None
        for s in range(40):
            t += rng.choice([-50, 30, 60, 60, 170, 181, 300])
            payload = rng.choice("aab")
            rows.append((key, s, t, payload))
            if last is None or payload != rows[-2][3] or not 0 <= t - last <= 180:
                want.add((key, s))
                last = t
    df = spark.createDataFrame(rows, "key long, s long, t long, payload string")
    got = {(r.key, r.s) for r in clean.drop_short_repeats(df, ["key"], "s", "t", "payload").collect()}
    assert got == want


def test_panel_disjoint_forecast_is_finite(spark):
    from tidemark import catalog

    got = catalog.queries()["panel_disjoint_forecast"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.scheme for r in got) == ["maximum", "maximum_count", "snapshot", "two_snapshots"] and all(0 < r.brier < 0.5 and r.rows > 50 for r in got)


def test_large_files_are_hashed_slice_by_slice(spark, tmp_path):
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    files = {"noise": noise, "ended": noise + b"\n", "marked": b"\xef\xbb\xbf" + noise, "lines": b"\n" * 90_000, "cr": b"a\r\n\r" * 30_000, "run": b"\0" * 100_000, "small": b"ab\n", "packed.gz": noise}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = readers.inventory(spark, str(tmp_path), slice_bytes=1 << 16).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}
    assert len(got) == len(want) and {r.path.rpartition("/")[2]: (r.length, r.sha256) for r in got} == want
