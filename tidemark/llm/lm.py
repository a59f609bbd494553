"""LM scoring by a log-frequency Bloom filter.

Counts of token sequences up to ORDER long are quantised on a logarithmic scale; one of level q is in the filter q times,
once for each level up to its own. The filter stands in segments by hash, each built and probed where it is: a block of
documents sends its sequences to their segments and gets their levels back, so the filter grows with its entries and is
never gathered. A count is read back by probing levels until one is missing; each order's probability is smoothed with
that of the order below, down to the token's own, whose counts are exact: a block meets the counts of its own tokens only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks_of, give_back, numbers, packed, parts_for, planes, received, same_on_every_reading, shipped, unpacked
from .common import stash

BLOCK_BYTES = 12 << 20
#: Text whose tokens are dealt to one part.
PART_BYTES = 4 << 20
#: Tokens of the longest sequences that are counted.
ORDER = 3
FOLDS, HELD_OUT = 7, 2
#: Bits of the filter for each entry, and probes for each; about 1.2 % of absent entries seem present.
ENTRY_BITS, PROBES = 10, 4
#: Counts c have level 1 + floor(log c / log LEVEL_BASE).
LEVEL_BASE = 1.6
#: Low bits of a sequence's hash that choose its part; the others are its name there. A part holds some million names
#: of 2 ** 40, at any size of the corpus, so two sequences share one about once in a million.
PART_BITS = 24
#: Weight of the order below against a sequence's count.
PRIOR_WEIGHT = 4.0
#: High bits of hashes by which a block's sequences are cut into ranges.
RANGE_BITS = 3
END = b""


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D5)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xC3A5C85C97CB3127)
    return x ^ (x >> np.uint64(31))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


class _Numbers(dict):
    """Tokens by number, in order of appearance."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def _sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lengths, hashes): all texts' tokens by number, each text closed by the end token; the tokens' hashes."""
    import xxhash

    numbers, codes, lengths = _Numbers(), [], []
    end = numbers[END]
    for text in texts:
        own = list(map(numbers.__getitem__, (text or "").encode().lower().split()))
        own.append(end)
        codes.append(np.array(own, np.int32))
        lengths.append(len(own))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
    return np.concatenate(codes) if codes else np.empty(0, np.int32), np.array(lengths, np.int64), hashes


def _places_in(lengths: np.ndarray) -> np.ndarray:
    """The place of each token in its text."""
    return np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)


def _sequences_of(codes: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the sequences of 2 to ORDER tokens that end at each token, a row for each order; before a text stand ends."""
    at = _places_in(lengths)
    out, last = np.empty((ORDER - 1, len(codes)), np.uint64), hashes[codes]
    for m in range(1, ORDER):
        h, inside = last * np.uint64(0x9FB21C651E98DF25), np.flatnonzero(at >= m)
        before = np.full(len(codes), hashes[0])
        before[inside] = hashes[codes[inside - m]]
        h += before
        del before, inside
        h += np.uint64(m)
        out[m - 1] = last = _mix(h)
    return out


def _distinct(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, distinct hashes in order, the number of each place's among them): h by rising ranges of hashes, which bound what is sorted at once."""
    top = (h >> np.uint64(64 - RANGE_BITS)).astype(np.uint8)
    for k in range(1 << RANGE_BITS):
        own = np.flatnonzero(top == k)
        yield own, *np.unique(h[own], return_inverse=True)


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places), in order of the parts and of places."""
    by = np.argsort(part, kind="stable").astype(np.int32)
    many = np.bincount(part)
    there = np.flatnonzero(many)
    edges = np.append(0, np.cumsum(many[there])).tolist()
    for p, a, b in zip(there.tolist(), edges, edges[1:], strict=False):
        yield p, by[a:b]


def _part(h: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """The part of each hash of a token (kind 0) or sequence (1)."""
    own = h % np.uint64(parts) if kind == 0 else (h & np.uint64((1 << PART_BITS) - 1)) % np.uint64(parts)
    return own.astype(np.uint16 if parts <= 1 << 16 else np.int32)


def _name(h: np.ndarray, kind: int) -> np.ndarray:
    """The names that hashes of one part have there; names of increasing hashes increase."""
    return h if kind == 0 else h >> np.uint64(PART_BITS)


def _count_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """(kind, part, block, blob): per block its tokens (0) and its sequences (1), each with its training count, 0 included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks_of(batches, 0, BLOCK_BYTES):
            out = counted(block, rows)
            give_back()
            yield out
            del out, rows

    def counted(block: int, rows: pa.Table) -> pa.RecordBatch:
        codes, lengths, hashes = _sequences(rows.column(0).to_pylist())
        train = np.repeat([not held_out(i) for i in rows.column(1).to_pylist()], lengths)
        counts = np.bincount(codes[train], minlength=len(hashes)).astype(np.uint32)
        order, out = np.argsort(hashes), []

        def deal(kind: int, h: np.ndarray, c: np.ndarray) -> None:
            for p, own in _dealt(_part(h, kind, parts)):
                out.append((kind, p, block, packed(planes(np.diff(_name(h[own], kind), prepend=np.uint64(0))), c[own])))

        deal(0, hashes[order], counts[order])
        h, grams, times = _sequences_of(codes, lengths, hashes).ravel(), [], []
        del codes, counts, order
        for own, seen, back in _distinct(h):
            grams.append(seen)
            times.append(np.bincount(back[train[own % len(train)]], minlength=len(seen)).astype(np.uint32))
        del h, own, back
        deal(1, np.concatenate(grams), np.concatenate(times))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
            ["kind", "part", "block", "blob"],
        )

    return docs.select("__text", "__id").mapInArrow(run, "kind int, part int, block long, blob binary")


def _levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def _places(h: np.ndarray, level: int, size: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """The bits of entries (h, level) within their segments."""
    a = _mix(h + np.uint64(level * 0xD6E8FEB86659FD93 % 2**64))
    b = _mix(a) | np.uint64(1)
    for _ in range(PROBES):
        yield a % size
        a = a + b


def _merge(parts: int, filter_bytes: int | None = None):
    """Per (kind, part): total counts of the tokens for the blocks they came from; or a segment of the filter (block -1)
    and the levels it shows of the sequences, for their blocks. filter_bytes: bound on all segments, None: what entries need.
    """

    def run(rows: pa.Table) -> pa.Table:
        kind, part = rows.column("kind")[0].as_py(), rows.column("part")[0].as_py()
        got = [unpacked(b, np.uint8, np.uint32) for b in rows.column("blob").to_pylist()]
        h = np.concatenate([np.cumsum(numbers(x, np.uint64), dtype=np.uint64) for x, _ in got])
        c = np.concatenate([y for _, y in got]).astype(np.int64)
        keys, back = np.unique(h, return_inverse=True)
        total = np.bincount(back, weights=c).astype(np.int64)
        edges = np.cumsum([0, *[len(y) for _, y in got]])
        n, m = np.zeros(len(got), np.int64), np.zeros(len(got), np.int64)
        blocks, first = rows.column("block").to_pylist(), None
        if kind == 0:
            own = total[back]
            n[0], m[0] = total.sum(), (total > 0).sum()
        else:
            there = total > 0
            seen, level = keys[there], _levels(total[there])
            size = int(level.sum()) * ENTRY_BITS
            if filter_bytes is not None:
                size = min(size, filter_bytes * 8 // parts)
            size = size // 64 * 64 + 64
            bits = np.zeros(size, bool)
            for q in range(1, int(level.max(initial=0)) + 1):
                for at in _places(seen[level >= q], q, np.uint64(size)):
                    bits[at] = True
            first = np.packbits(bits, bitorder="little").tobytes()
            del bits
            own = Filter([(0, size, first)], 1).levels(keys).astype(np.uint8)[back]
        blobs = [packed(own[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        out = (blocks, n, m, blobs)
        if first is not None:
            out = ([-1, *blocks], [int(level.sum()), *n], [size, *m], [first, *blobs])
        n = len(out[0])
        return pa.table(
            [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(out[0], pa.int64()),
             pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
            names=["kind", "part", "block", "n", "m", "blob"],
        )

    return run


class Filter:
    """Segments of the filter by hash, one after another."""

    def __init__(self, segments: list[tuple[int, int, bytes]], parts: int) -> None:
        self.parts, self.size, self.start = parts, np.full(parts, 64, np.uint64), np.zeros(parts, np.int64)
        at, held = 0, []
        for part, size, bits in sorted(segments):
            self.size[part], self.start[part] = size, at * 8
            held.append(bits)
            at += len(bits)
        self.empty = np.ones(parts, bool)
        self.empty[[p for p, _, _ in segments]] = False
        self.bits = np.frombuffer(b"".join(held), np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """For each hash the highest level that is there with all below it, 0 if none is."""
        part = (h % np.uint64(self.parts)).astype(np.int64)
        level = np.zeros(len(h), np.int64)
        live = np.flatnonzero(~self.empty[part])
        for q in range(1, 64):
            size, start, own = self.size[part[live]], self.start[part[live]], h[live]
            there = np.ones(len(live), bool)
            for at in _places(own, q, size):
                bit = start + at.astype(np.int64)
                there &= (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            live = live[there]
            if not len(live):
                break
            level[live] = q
        return level

    def counts(self, h: np.ndarray) -> np.ndarray:
        return _counts(self.levels(h))


def _counts(level: np.ndarray) -> np.ndarray:
    """The middle of each level, 0 for level 0."""
    level = level.astype(float)
    return np.where(level > 0, (LEVEL_BASE ** (level - 1) + np.maximum(LEVEL_BASE**level - 1, 1)) / 2, 0.0)


def score_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Learnt from the documents whose crc32(id as text) mod 7 is not 2; tokens are words with A-Z lower-cased, and one
    end per text. base_score: tokens' smoothed own probabilities, from exact counts; score: of each token after the
    ones before it, for each order (count of the sequence + 4 p) / (count of its beginning + 4), p from the order below, and the
    sequence's count at most that of its beginning. Null texts are empty; a null id is in training; rows that repeat an
    id are texts of their own. Empty table: empty result.
    """
    d = same_on_every_reading(docs.select(F.col(text).cast("string").alias("__text"), F.col(doc).cast("long").alias("__id")))
    parts = parts_for(d, "__text", PART_BYTES)
    merged = stash(
        _count_blocks(d, parts).groupBy("kind", "part").applyInArrow(
            _merge(parts), "kind int, part int, block long, n long, m long, blob binary"
        ).where("block >= 0"),
        "counts",
    )
    total = merged.where("kind = 0").agg(F.sum("n"), F.sum("m")).first()
    n, v = int(total[0] or 0), int(total[1] or 0)

    def score(docs: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        for rows in received(docs):
            codes, lengths, hashes = _sequences(rows.column(0).to_pylist())
            ids = rows.column(1)
            order = np.argsort(hashes)
            h = _sequences_of(codes, lengths, hashes).ravel()
            at, back, part = 0, np.empty(len(h), np.int32), []
            for own, seen, number in _distinct(h):
                back[own] = number + at
                part.append(_part(seen, 1, parts))
                at += len(seen)
            del h, own, seen, number
            c, level = np.zeros(len(hashes), np.int64), np.zeros(at, np.uint8)
            own = [dict(_dealt(x)) for x in (_part(hashes[order], 0, parts), np.concatenate(part))]
            for kind, p, blob in zip(*[counts.column(x).to_pylist() for x in ("kind", "part", "blob")], strict=True):
                if kind == 0:
                    c[order[own[0][p]]] = unpacked(blob, np.int64)[0]
                else:
                    level[own[1][p]] = unpacked(blob, np.uint8)[0]
            own, middle = (c + 1) / (n + v + 1), _counts(np.arange(64))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            first = np.zeros(len(codes), bool)
            first[starts] = True
            p, beginning = own[codes], c[np.concatenate([[0], codes[:-1]])].astype(float)
            for numbers_of in back.reshape(ORDER - 1, -1):
                times = np.minimum(middle[level[numbers_of]], beginning)
                p = (times + PRIOR_WEIGHT * p) / (beginning + PRIOR_WEIGHT)
                # Nothing begins before a text but with its end token.
                beginning = np.where(first, 0.0, np.concatenate([[0.0], times[:-1]]))
            sums = [np.add.reduceat(x, starts) for x in ((c > 0)[codes].astype(np.int64), np.log10(own)[codes], np.log10(p))]
            out.append(pa.table(
                [ids.combine_chunks(), pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(lengths), pa.array(sums[0]),
                 pa.array(np.full(len(lengths), n)), pa.array(sums[1]), pa.array(sums[2])],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ))
        return pa.concat_tables(out)

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    counts = merged.select("block", "kind", "part", "blob")
    done = shipped(d, BLOCK_BYTES).groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(score, schema)
    return done.withColumnRenamed("id", doc)
