"""The n-gram Jaccard join, and near duplicates under repeated ids, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_small import SCHEMA, clashing, frame, near, prose
from tidemark.llm import near_dup, prefix_join, queries

SF = "/root/testdata/sf0.001"


def near_texts(rng):
    texts = [None, "", "   ", "one", "One", "two words", "Two Words"]
    for n in (40, 60, 150):
        base = prose(rng, n).split()
        for _ in range(25):  # copies with a few changed words: links to some of the others only
            own = list(base)
            for k in rng.sample(range(n), rng.randint(0, n // 20)):
                own[k] = "new" + str(rng.randint(0, 10**6))
            texts.append(" ".join(own))
    shared = prose(rng, 25)
    texts += [prose(rng, rng.randint(1, 60)) + " " + shared + " " + prose(rng, rng.randint(1, 60)) for _ in range(20)]
    return texts + [prose(rng, 50) for _ in range(20)] + texts[7:12]


@pytest.mark.parametrize(("words", "num", "block", "counters"), [(3, 90, 8, 4), (5, 80, 4096, 1 << 18)])
def test_components(spark, monkeypatch, words, num, block, counters):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(prefix_join, "COUNTERS", counters)
    texts = near_texts(random.Random(words))
    df = clashing(frame(spark, texts)).unionByName(clashing(frame(spark, ["null id"])).withColumn("doc_id", F.lit(None).cast("long")))
    got = prefix_join.jaccard_components(df, words, num, 100).collect()
    assert len(got) == len(texts) + 1
    want = near(dict(enumerate(texts)), words, num, 100)
    for r in got:
        assert (r.component_id is None) if r.doc_id is None else ((r.n_shingles, r.component_id) == want[r.doc_id])


def test_nothing_and_very_long_texts(spark):
    assert prefix_join.jaccard_components(frame(spark, [])).count() == 0
    rng = random.Random(3)
    long = prose(rng, 160_000)
    texts = {0: long, 1: "own " + long, 2: long[: len(long) // 2], 3: prose(rng, 30), 4: None}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in prefix_join.jaccard_components(frame(spark, list(texts.values())), 3, 90, 100).collect()}
    assert got == near(texts, 3, 90, 100) and got[1][1] == 0 and got[2][1] == 2


def test_prefix_filters_never_reject_similar_sets():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        base = np.unique(rng.integers(0, 2**63, n + 40).astype(np.uint64))
        one = np.sort(rng.choice(base, n, replace=False))
        keep = one[rng.random(n) > 0.06]
        two = np.unique(np.append(keep, rng.choice(base, int(rng.integers(0, max(1, n // 15))))))
        common = len(np.intersect1d(one, two))
        if not len(two) or 100 * common < 90 * (n + len(two) - common):
            continue
        counts = rng.integers(0, 5, prefix_join.COUNTERS)
        (f1, o1), (f2, o2) = (prefix_join.prefixes(s, counts, 90, 100) for s in (one, two))
        assert set(np.frombuffer(f1, np.uint64)) & set(np.frombuffer(f2, np.uint64))
        for x, y in zip(prefix_join._split(o1), prefix_join._split(o2), strict=True):
            shared = np.array([len(np.intersect1d(x, y))])
            assert prefix_join.may_link(np.array([n]), np.array([len(two)]), np.array([len(x)]), shared, 90, 100)[0]


def test_op12_over_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = near(texts, 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op12_ngram_jaccard_join(spark, SF).collect()} == want


def repeated(spark):
    rng = random.Random(9)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (7, a + " x"), (7, b), (9, b + " y"), (9, b + " y")]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA), a, b


def test_rows_of_one_id_with_different_texts(spark):
    df, _, _ = repeated(spark)
    for turned in (df, df.orderBy(F.desc("doc_id"))):
        got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(turned, 3, 85, 100).collect())
        assert got == [(1, 1, True), (7, 1, False), (7, 7, True), (9, 7, False), (9, 7, False)]
        got = sorted((r.doc_id, r.component_id) for r in prefix_join.jaccard_components(turned, 3, 85, 100).collect())
        assert got == [(1, 1), (7, 1), (7, 7), (9, 7), (9, 7)]


def test_pipeline_removes_rows_not_ids(spark):
    import corpus_pipeline

    df, a, b = repeated(spark)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, df, "").collect()) == [(1, a), (7, b)]


def test_parities_keep_every_similar_pair_and_few_others():
    rng, num, den = np.random.default_rng(12), 90, 100
    for n in (1, 3, 20, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        n = len(a)
        for gone, new in ((0, n // 20), (n // 20, 0), (n // 40, n // 40)):
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
            c, m = n - gone, len(b)
            if den * c < num * (n + m - c):
                continue
            x, y = (pa.array([prefix_join.parities(s, num, den)], pa.list_(pa.int64())) for s in (a, b))
            w = min(len(x[0]), len(y[0]))
            apart = np.bitwise_count(prefix_join._folded(x, np.array([0]), w) ^ prefix_join._folded(y, np.array([0]), w)).sum()
            assert prefix_join.alike(apart, n, m, num, den), (n, m)
        other = prefix_join.parities(rng.integers(0, 2**63, n).astype(np.uint64), num, den).view(np.uint64)
        apart = np.bitwise_count(prefix_join.parities(a, num, den).view(np.uint64) ^ other).sum()
        assert n < 20 or not prefix_join.alike(apart, n, n, num, den)


def test_small_groups_meet_in_one_block(spark):
    # Two members of different roots came twice: with their own block, and with the other's.
    rows = [(1, i, i, 8) for i in range(2)] + [(2, 10 + i, 10 + i // 2, 8) for i in range(6)] + [(3, 20 + i, 20 if i < 4 else 30 + i, 8) for i in range(6)]
    got = near_dup.in_blocks(spark.createDataFrame(rows, "key long, id long, root long, bytes long")).collect()
    count = {k: sum(r.key == k for r in got) for k in (1, 2, 3)}
    assert count[1] == 2 and count[2] == 6
    met = {(r.key, r.lo, r.hi) for r in got}
    for key, i, root, _ in rows:
        for other, j, that, _ in rows:
            if key == other and root != that:
                assert any({(key, lo, hi, i), (key, lo, hi, j)} <= {(r.key, r.lo, r.hi, r.id) for r in got} for _, lo, hi in met)
