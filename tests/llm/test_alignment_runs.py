"""Tokenizer alignment and periodic runs against brute force, over random, odd and very long texts and a whole test table."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_llm_small import clashing, frame, prose
from tidemark.llm import alignment, periodic, queries

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
ALPHABET = alignment.byte_alphabet()
A_BYTES = {i: bytes(ALPHABET[c] for c in t) for t, i in A.get_vocab().items() if i != 50256}
B_BYTES = alignment._piece_bytes(B)
RANKS = alignment.read_byte_level(P.path("byte_bpe_50k.json"))
ZEROS = (0, 0, 0, 0, 0, 0, "")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def aligned(texts):
    """Of each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), token by token, whole texts at once."""
    groups, links = [], []
    for t in texts:
        a, b = (A.encode(" " + t, add_special_tokens=False).ids, B.encode(t)) if t else ([], [])
        whole = (" " + t).encode() if t else b""
        if b"".join(A_BYTES[i] for i in a) != whole or b"".join(B_BYTES[i] for i in b) != whole:
            a, b = [], []
        ends = [set(np.cumsum([len(of[i]) for i in ids]).tolist()) for ids, of in ((a, A_BYTES), (b, B_BYTES))]
        cuts, found = sorted(ends[0] & ends[1]) if a else [], []
        at = [0, 0]
        for cut in cuts:
            group = []
            for n, (ids, of) in enumerate(((a, A_BYTES), (b, B_BYTES))):
                left = cut - (found[-1][2] if found else 0)
                first = at[n]
                while left:
                    left -= len(of[ids[at[n]]])
                    at[n] += 1
                group.append(ids[first : at[n]])
            found.append((*group, cut))
        groups.append([g[:2] for g in found])
        links.append(Counter((x, y) for one, two, _ in found for x in one for y in two))
    holds = Counter(p for own in links for p in own)
    highest = defaultdict(int)
    for (x, _), n in holds.items():
        highest[x] = max(highest[x], n)
    out = []
    for g, own in zip(groups, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in own.items() if holds[p] == highest[p[0]])
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), best, sum(n * holds[p] for p, n in own.items()), sha(text) if g else ""))
    return out


def columns(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def run_aligned(docs):
    return alignment.aligned_texts(docs, RANKS, P.PATTERN, P.path("piece_bpe_32k.model"))


def test_alignment_of_odd_and_very_long_texts(spark):
    rng = random.Random(5)
    letters = [*"ab  \n\té.,'ss 1２　\x1c\x85\xa0漢字#$ \r\x00\x7f", "'s", "'ll", " the", "  ", "   ", "<0x0A>", "<s>", "<|endoftext|>", "🙂", "é", "​", "﻿", "ﬁ"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(800)]
    texts += [None, "", " ", "   ", "a▁b", "x ▁ y", "word " * 3, "same words", "same words", " lead", "trail ", "a" * 3000, "漢字" * 900, "\n" * 700, "0" * 999]
    texts += [" ".join(rng.choice(["the", "of", "zqxj", "漢字", "Ünder", "don't", "12,5"]) + rng.choice(["", ".", "\n\n", "  "]) for _ in range(60_000))]
    docs = clashing(frame(spark, texts)).repartition(5)
    want = aligned(texts)
    got = {r.row.c0: columns(r) for r in run_aligned(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == want[i], (repr((t or "")[:80]), got[i], want[i])
    assert want[texts.index("a▁b")] == ZEROS and got[texts.index(None)] == ZEROS


def test_large_groups_are_counted_by_their_distinct_ids(monkeypatch):
    rng = np.random.default_rng(1)
    ends = np.cumsum(rng.integers(1, 4, 400))
    a, b = rng.integers(0, 5, 400), rng.integers(0, 6, 300)
    other = np.sort(np.append(rng.choice(ends[:-1], 40, replace=False), rng.choice(np.setdiff1d(np.arange(1, ends[-1]), ends), 259, replace=False)))
    other = np.append(other, ends[-1])
    x = alignment.align(ends, other, ends[-1:])
    plain = alignment.expand_links(x, a, b)
    monkeypatch.setattr(alignment, "LINKS", 3)
    assert all((p == q).all() for p, q in zip(plain, alignment.expand_links(x, a, b)))


def test_alignment_of_nothing_and_repeats(spark):
    assert run_aligned(frame(spark, [])).count() == 0
    twice = frame(spark, ["some words"]).union(frame(spark, ["some words"]))
    got = [columns(r) for r in run_aligned(twice).collect()]
    assert got[0] == got[1] and got[0][5] == 2 * got[0][3]


def test_op11_over_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, aligned(list(texts.values()))))
    got = {r.doc_id: columns(r) for r in queries.op11_tokenizer_alignment(spark, SF).collect()}
    assert got == want


# 13


def brute_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            seg = w[start : i + q]
            if len(seg) >= max(least, 2 * q) and not any(seg[r:] == seg[:-r] for r in range(1, q)):
                out.append((start, len(seg), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


@pytest.mark.parametrize("least", [2, 12])
def test_runs_match_brute_force(least):
    rng = random.Random(least)
    for n in range(400):
        docs = [[rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(1, 5))]
        if n % 2:
            docs = [d[: rng.randint(0, 9)] + d[: rng.randint(1, 12)] * rng.randint(1, 9) + d[:5] for d in docs]
        sizes = [len(d) for d in docs]
        base = np.cumsum(sizes) - sizes
        got = periodic.runs_of(np.repeat(np.arange(len(docs)), sizes), np.array(sum(docs, []), np.int64), least).tolist()
        assert got == [[s + b, s + b + k, q] for d, b in zip(docs, base.tolist()) for s, k, q in brute_runs(d, least)]


def test_small_batches_of_leaves_find_the_same(monkeypatch):
    word = np.random.default_rng(2).integers(0, 3, 3000)
    whole = periodic.runs_of(np.zeros(3000, np.int64), word, 12).tolist()
    monkeypatch.setattr(periodic, "LEAVES", 50)
    monkeypatch.setattr(periodic, "ROTATED", 1)
    assert periodic.runs_of(np.zeros(3000, np.int64), word, 12).tolist() == whole and whole


def test_runs_of_odd_and_very_long_texts(spark):
    rng = random.Random(8)
    texts = [None, "", " \n ", "one", "a " * 11, "a " * 12, "a b " * 6 + "a", "x\x1cy " * 14, "a\xa0b c　d " * 9, "same a b a b", "same a b a b"]
    texts += [prose(rng, 120_000) + " " + "p q r " * 5000 + prose(rng, 20), "w " * 200_000]
    got = {r.row.c0: r for r in periodic.periodic_runs(clashing(frame(spark, texts))).collect()}
    for i, t in enumerate(texts[:-2]):
        w = (t or "").encode().split()
        want = brute_runs(w)
        assert [tuple(r) for r in got[i].runs] == want and got[i].collapsed == collapsed(w, want) and got[i].n_words == len(w)
    assert [tuple(r) for r in got[len(texts) - 2].runs] == [(120_000, 15_000, 3)] and [tuple(r) for r in got[len(texts) - 1].runs] == [(0, 200_000, 1)]
    assert got[len(texts) - 1].collapsed == "w" and periodic.periodic_runs(frame(spark, [])).count() == 0


def test_planted_tail_of_null_and_empty():
    hot = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert periodic.planted_tail(None, [b"a"]) == [b"a"] and periodic.planted_tail(hot, []) == []


def test_op13_over_a_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs.items():
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 1500:
            w, n = None, n  # brute force is quadratic; long texts are compared above
        r = got[i]
        if w is None:
            continue
        runs = brute_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (*((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(collapsed(w, runs)))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (len(runs), *want), i
