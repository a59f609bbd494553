"""Operators over a whole test table, and over very long texts, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_small import RANKS, TOKENS, P, frame, lines_left, near, prose, removed, stats
from tidemark.llm import bpe, decontaminate, line_dedup, lm, near_dup, packing, quality, queries, secret_scan, suffix_dedup

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_over_a_table(spark, texts):
    for r in queries.op1_byte_bpe(spark, SF).collect():
        ids = TOKENS.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_op2_over_a_table(spark, texts):
    want = removed(texts)
    for r in queries.op2_suffix_dedup(spark, SF).collect():
        kept, gone, spans = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(texts[r.doc_id].encode()), gone, spans, sha(kept))


def test_op3_over_a_table(spark, texts):
    want = near(texts, 3, 85, 100)
    for r in queries.op3_minhash_near_dedup(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_op9_over_a_table(spark, texts):
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    one = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(one.values()), len(one)
    for r in queries.op9_lm_scoring(spark, SF).collect():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)


def verdicts(spark, rows):
    """doc_id -> (kept, squared distance) by NumPy; rows: doc_id, text, lang, source."""
    d, some = quality.D, {}
    for i, text, lang, source in rows:
        w, chars, symbols, dups, repeats = stats(text)
        if not (w < 20 or 100 * repeats > 30 * w):
            some[i] = [math.log1p(w), math.log(chars / w), math.log1p(100 * symbols / chars), repeats / w, math.log1p(dups)]
    names = [f"f{k}" for k in range(d)]
    own = spark.createDataFrame([(i, *x) for i, x in some.items()], "id long, " + ", ".join(f"{c} double" for c in names))
    rest = {r.id: r.h for r in own.select("id", F.pmod(F.xxhash64(*names), F.lit(4)).alias("h")).collect()}
    group = {i: (lang or "", source or "") for i, _, lang, source in rows}
    sizes = Counter(group[i] for i in some)
    langs = Counter(group[i][0] for i in some)
    floors, cutoff = np.array(quality.FLOORS) ** 2, quality.chi2_quantile(1 - quality.TAIL, d)
    scale = quality.ALPHA / quality._gamma_p(d / 2 + 1, quality.chi2_quantile(quality.ALPHA, d) / 2)
    middle = lambda x: np.sort(x, 0)[math.ceil(0.5 * len(x)) - 1]
    fits = {}

    def fit(of):
        ids = [i for i in some if of(i)]
        x = np.array([some[i] for i in ids])
        moments = lambda y: (y.mean(0), scale * np.cov(y.T, bias=True) + np.diag(floors))
        m = middle(x)
        starts = [(m, np.diag((middle(abs(x - m)) * 1.4826) ** 2 + floors)), moments(x)]
        starts += [moments(x[[rest[i] == k for i in ids]]) for k in quality.SUBSETS if any(rest[i] == k for i in ids)]
        ends = []
        for mean, cov in starts:
            for _ in range(quality.STEPS):
                dist = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
                bins = np.floor(np.log(dist + 1e-6) * 64)
                edge = np.sort(bins)[math.ceil(quality.ALPHA * len(bins)) - 1]
                mean, cov = moments(x[bins <= edge])
            ends.append((np.linalg.slogdet(cov)[1], len(ends), mean, cov, len(x)))
        return min(ends, key=lambda e: e[:2])

    out = {}
    for i, *_ in rows:
        lang, source = group[i]
        level = 0 if sizes[lang, source] >= quality.MIN_GROUP else 1 if langs[lang] >= quality.MIN_GROUP else 2
        name = [(lang, source), lang, None][level]
        if i not in some:
            out[i] = (False, None)
            continue
        if name not in fits:
            fits[name] = fit([lambda j: group[j] == name, lambda j: group[j][0] == name, lambda j: True][level])
        _, _, mean, cov, n = fits[name]
        far = float((np.array(some[i]) - mean) @ np.linalg.inv(cov) @ (np.array(some[i]) - mean))
        out[i] = (n < quality.MIN_GROUP or far <= cutoff, far)
    return out, cutoff


def test_op8_over_a_table(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang", "source")
    want, cutoff = verdicts(spark, [tuple(r) for r in docs.collect()])
    got = queries.op8_quality_rules(spark, LARGER).collect()
    assert len(got) == len(want)
    for r in got:
        kept, far = want[r.doc_id]
        if far is None:
            assert r.base_failed and not r.kept
        elif abs(far - cutoff) > 0.01 * cutoff:
            assert (r.kept, r.base_failed) == (kept, False) and math.isclose(r.mahalanobis_sq, far, rel_tol=1e-3, abs_tol=1e-3)
    assert any(not r.kept and not r.base_failed for r in got)


def test_op10_packs_as_by_hand(spark, texts):
    tokens = packing.tokenised(spark.read.parquet(f"{SF}/documents.parquet"), RANKS, P.PATTERN)
    got = packing.pack(tokens, row=256, bin_tokens=10**9).select("n_tokens").collect()
    sizes, free = [], []
    for t in texts.values():
        n = len(TOKENS.encode_ordinary(t))
        sizes += [256] * (n // 256) + [n % 256] * (n % 256 > 0)
    for size in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= size]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 256) - size)
    assert sorted(r.n_tokens for r in got) == sorted(256 - f for f in free)


def test_very_long_texts(spark):
    rng = random.Random(31)
    long = "\n".join(prose(rng, 8) for _ in range(20_000))
    assert len(long) > 1_000_000
    docs = {0: long, 1: "own words " + long[:600_000] + "\npassword: hunter22", 2: prose(rng, 30), 3: long, 4: None}
    df = frame(spark, list(docs.values()))
    want = removed({i: t or "" for i, t in docs.items()})
    assert {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(df).collect()} == want
    pairs = near(docs, 5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()} == pairs
    lines = lines_left(docs, 2)
    assert {r.doc_id: (r.text or "", r.n_lines, r.n_removed) for r in line_dedup.line_dedup(df).collect()} == lines
    items = spark.createDataFrame([(1, " ".join(long.split()[5000:5012])), (2, prose(rng, 12))], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination(df, items).collect()}
    assert hits == {0: (160_000, 12), 1: (len(docs[1].split()), 12), 2: (30, 0), 3: (160_000, 12), 4: (0, 0)}
    found = {r.doc_id: r.spans for r in secret_scan.secret_report(secret_scan.find_secrets(df)).collect()}
    at = docs[1].index("password")
    assert found == {0: "", 1: f"assign:{at}:{at + 18}", 2: "", 3: "", 4: ""}
    for r in quality.quality_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(docs[r.doc_id])
    assert {r.doc_id: r.n_tokens for r in lm.score_texts(df).collect()} == {i: len((t or "").split()) + 1 for i, t in docs.items()}
    ids = {r.doc_id: list(r.ids) for r in bpe.encode(df, RANKS, P.PATTERN).collect()}
    assert ids == {i: TOKENS.encode_ordinary(t or "") for i, t in docs.items()}
    packed = packing.pack(packing.tokenised(df, RANKS, P.PATTERN))
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(map(len, ids.values()))


def test_word_classes_agree_with_the_contract():
    # Words of the contract's classes, as the tests' own splitting assumes.
    t = "a\x0bb\x1cc d\te\x85f"
    assert re.findall(r"[^\x20\x09-\x0D]+", t) == [x.decode() for x in t.encode().split()]
