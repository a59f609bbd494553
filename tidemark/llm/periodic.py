"""Periodic runs of words: a generalised suffix tree per batch of documents, after Stoye and Gusfield.

The tree's inner nodes are the intervals of a suffix array in which neighbours share the node's depth of words. Each
node looks at the leaves of all its children but the largest (the smaller half, so n log n leaves in all): leaf i of a
node of depth q begins or ends a branching tandem repeat if leaf i + q or i - q hangs under another child of that node.
Rotating a branching repeat to the left as far as words agree gives its run; repeats of one end whose period is a
multiple of a shorter one's merge into that one's run. Nothing spans documents: suffixes are ordered by document first.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, from_row, quoted

#: Words whose tree is in a task's memory at once, about; a longer document has a tree by itself.
BATCH_WORDS = 400_000
#: Leaves looked at together.
LEAVES = 1 << 21
#: Depths of the tree that are taken one by one.
SHALLOW = 12
#: Words by which all repeats are rotated together before the few longer ones go on alone.
ROTATED = 24


def _prefix_length(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Common words of suffixes a and b, from the ranks by 1, 2, 4, .. words; a, b at their document's end share none."""
    n, same = len(end), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + same, b + same
        inside = (x < end[a]) & (y < end[b]) if len(a) else np.zeros(0, bool)
        equal = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        same[equal] += 1 << k
    return same


def suffix_array(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, shared): suffixes by document, then words; shared[k] words with the one before, 0 for another document.

    Ranks by the first 1, 2, 4, .. words; each round sorts the suffixes that are not alone yet.
    """
    n = len(word)
    key = doc.astype(np.int64) << 32 | word
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = np.diff(key[order]) != 0
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    edges = np.flatnonzero(np.diff(doc)) + 1
    end = np.append(edges, n)[np.searchsorted(edges, slot, "right")]
    shared, levels, step = np.zeros(n, np.int64), [rank.astype(np.int32)], 1
    alone = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~alone)
    while len(open_):
        p = order[open_]
        after = np.where(p + step < end[p], rank[np.minimum(p + step, n - 1)] + 1, 0)
        key = rank[p] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        p, key = p[by], key[by]
        order[open_] = p
        first = np.ones(len(p), bool)
        first[1:] = np.diff(key) != 0
        edge = np.flatnonzero(first[1:] & (rank[p[1:]] == rank[p[:-1]])) + 1
        a, b = p[edge - 1], p[edge]
        # Suffixes right at the document's end have no further words.
        x, y = np.minimum(a + step, n - 1), np.minimum(b + step, n - 1)
        more = (a + step < end[a]) & (b + step < end[b])
        length = np.zeros(len(edge), np.int64)
        length[more] = _prefix_length(levels, x[more], y[more], end)
        shared[open_[edge]] = step + length
        rank[p] = open_[np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))]
        levels.append(rank.astype(np.int32))
        single = first & np.append(first[1:], True)
        open_ = open_[~single]
        step *= 2
    return order, rank, shared


def _doubled(v: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For the places `of`: the nearest place to the left with a smaller value, by doubling pointers."""
    at = np.arange(-1, len(v) - 1)
    todo = of[v[of - 1] >= v[of]]
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[v[at[todo]] >= v[todo]]
    return at[of]


def _nearest_smaller(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places to the left and right with a smaller value, where v > 0; both ends of v are smaller than all.

    Small values go one after another, each over what lies between places of smaller ones; the few large ones together.
    """
    before, after, at = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.arange(len(v))
    for depth in range(1, SHALLOW + 1):
        # Only deeper places and their neighbours matter.
        deep = v >= depth
        near = deep.copy()
        near[1:] |= deep[:-1]
        near[:-1] |= deep[1:]
        v, at, deep = v[near], at[near], deep[near]
        if not len(v):
            return before, after
        here, place = np.flatnonzero(v == depth), np.arange(len(v))
        before[at[here]] = at[np.maximum.accumulate(np.where(deep, 0, place))[here]]
        after[at[here]] = at[np.minimum.accumulate(np.where(deep, len(v) - 1, place)[::-1])[::-1][here]]
    of = np.flatnonzero(v > SHALLOW)
    before[at[of]] = at[_doubled(v, of)]
    after[at[of]] = at[len(v) - 1 - _doubled(v[::-1], (len(v) - 1 - of)[::-1])[::-1]]
    return before, after


def _children(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, lo, hi, from, to) of every child of an inner node but the node's largest: slots of the node and of the child."""
    n = len(shared)
    v = np.concatenate([[-1], shared[1:], [-1]])  # v[k] stands between slots k - 1 and k
    at = np.flatnonzero(v > 0)
    lo, hi = (x[at] for x in _nearest_smaller(v))
    by = np.argsort(lo * (n + 1) + hi, kind="stable")
    at, lo, hi = at[by], lo[by], hi[by]
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(lo) != 0) | (np.diff(hi) != 0)
    node = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    # A node with m edges has m + 1 children: one from each edge on, and one before the first.
    start, of = np.empty(len(at) + len(heads), np.int64), np.empty(len(at) + len(heads), np.int64)
    place = np.arange(len(at)) + node + 1
    start[place], of[place] = at, node
    start[place[heads] - 1], of[place[heads] - 1] = lo[heads], np.arange(len(heads))
    stop = np.append(start[1:], 0)
    last = np.append(place[heads][1:] - 2, len(start) - 1) if len(heads) else np.zeros(0, np.int64)
    stop[last] = hi[heads]
    size = stop - start
    most = np.maximum.reduceat(size, place[heads] - 1) if len(heads) else size
    largest = np.flatnonzero(size == most[of]) if len(heads) else np.zeros(0, np.int64)
    largest = largest[np.unique(of[largest], return_index=True)[1]]
    rest = np.ones(len(start), bool)
    rest[largest] = False
    of = heads[of[rest]]
    return v[at[of]], lo[of], hi[of], start[rest], stop[rest]


def branching_repeats(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every tandem repeat that the next word does not go on."""
    order, rank, shared = suffix_array(doc, word)
    n = len(order)
    depth, lo, hi, start, stop = _children(shared)
    ends = np.cumsum(stop - start)
    found_at, found_q, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while a < len(ends):
        base = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + LEAVES)))
        size = stop[a:b] - start[a:b]
        of = np.repeat(np.arange(a, b), size)
        i = order[np.arange(len(of)) - np.repeat(ends[a:b] - size - base, size) + start[of]]
        for sign in (1, -1):
            j = i + sign * depth[of]
            inside = (j >= 0) & (j < n)
            r = rank[np.where(inside, j, 0)]
            # Slots lo to hi belong to one document.
            hit = inside & (r >= lo[of]) & (r < hi[of]) & ((r < start[of]) | (r >= stop[of]))
            found_at.append(np.minimum(i, j)[hit])
            found_q.append(depth[of][hit])
        a = b
    place, q = np.concatenate(found_at), np.concatenate(found_q)
    both = np.unique(place * (n + 1) + q)
    return both // (n + 1), both % (n + 1)


def _rotated(word: np.ndarray, begin: np.ndarray, place: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The start of each repeat's run: how far it can be rotated to the left within its document (begin)."""
    at = place.copy()
    open_ = np.arange(len(at))
    for _ in range(ROTATED):
        open_ = open_[at[open_] > begin[open_]]
        open_ = open_[word[at[open_] - 1] == word[at[open_] - 1 + q[open_]]]
        if not len(open_):
            return at
        at[open_] -= 1
    for k in open_.tolist():
        i, shift, least, step = int(at[k]), int(q[k]), int(begin[k]), 64
        while i > least:
            m = min(step, i - least)
            differ = np.flatnonzero(word[i - m : i] != word[i - m + shift : i + shift])
            if len(differ):
                i -= m - 1 - int(differ[-1])
                break
            i, step = i - m, 2 * step
        at[k] = i
    return at


def runs_of(doc: np.ndarray, word: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least `least` words and two periods, by start, then period.

    doc: number of each word's document, not decreasing; word: the words as numbers.
    """
    if not len(word):
        return np.zeros((0, 3), np.int64)
    place, q = branching_repeats(doc, word)
    first = np.append(0, np.flatnonzero(np.diff(doc)) + 1)
    end = place + 2 * q
    by = np.lexsort((q, end))
    place, q, end, found = place[by], q[by], end[by], [np.zeros((0, 3), np.int64)]
    while len(place):
        head = np.ones(len(end), bool)
        head[1:] = np.diff(end) != 0
        begin = first[np.searchsorted(first, place[head], "right") - 1]
        start = _rotated(word, begin, place[head], q[head])
        found.append(np.stack([start, end[head], q[head]], 1))
        of = np.cumsum(head) - 1
        merged = (q % q[head][of] == 0) & (place >= start[of])
        place, q, end = place[~(head | merged)], q[~(head | merged)], end[~(head | merged)]
    out = np.concatenate(found)
    out = out[out[:, 1] - out[:, 0] >= least]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


Rewrite = Callable[[object, list[bytes]], list[bytes]]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12, doc: str = "doc_id", rewrite: Rewrite | None = None) -> DataFrame:
    """docs (all columns, whatever their names, in struct `row`) with n_words, runs and collapsed.

    runs: array<struct<start, length, period>> by start, then period: the maximal stretches of words with that smallest
    period, two periods and `least` words at least. collapsed: the words joined by one space, without those that a run
    contains after its first period. Words are what white space (20, 09 to 0D) parts. Null, empty and blank texts have no
    words, no runs and an empty collapsed text. rewrite: given a row's `doc` and words, the words to take instead. Rows are
    independent, so repeated rows and ids, or nulls, need no care; no row is shuffled. Empty table: empty result.
    """
    rows = docs.select(as_row(docs).alias("row"), quoted(doc).alias("doc"), quoted(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def flush(held: list[tuple[pa.RecordBatch, list[list[bytes]]]]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = defaultdict(itertools.count().__next__)
        texts = [w for _, part in held for w in part]
        sizes = np.array([len(w) for w in texts], np.int64)
        word = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        del known
        runs = runs_of(np.repeat(np.arange(len(texts)), sizes), word, least)
        base = np.cumsum(sizes) - sizes
        of = np.searchsorted(base + sizes, runs[:, 0], "right")
        gone = np.zeros(len(word) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 1], -1)
        gone = np.cumsum(gone) > 0
        edge, k = np.searchsorted(of, np.arange(len(texts) + 1)), 0
        entry = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - base[of], runs[:, 1] - runs[:, 0], runs[:, 2])], ["start", "length", "period"])
        for batch, part in held:
            left = []
            for n, w in enumerate(part, k):
                if edge[n] < edge[n + 1]:
                    w = [w[i] for i in np.flatnonzero(~gone[base[n] : base[n] + sizes[n]]).tolist()]
                left.append(b" ".join(w).decode())
            lists = pa.ListArray.from_arrays(pa.array(edge[k : k + len(part) + 1], pa.int32()), entry)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes[k : k + len(part)]), lists, pa.array(left, pa.string())], ["row", "n_words", "runs", "collapsed"])
            k += len(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [(t or "").encode().split() for t in part.column(2).to_pylist()]
                if rewrite is not None:
                    words = [rewrite(i, w) for i, w in zip(part.column(1).to_pylist(), words, strict=True)]
                held.append((part, words))
                n += sum(map(len, words))
                if n >= BATCH_WORDS:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(run, f"row {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted_tail(doc: object, words: list[bytes]) -> list[bytes]:
    """The query's input: of every tenth document by crc32 of its id, the tail from a stated word on repeats its beginning."""
    import zlib

    if doc is None or not words or (h := zlib.crc32(str(doc).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def run_report(found: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, n_runs, the longest run's start, length, period and exponent, digests) from periodic_runs' rows."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    # An entry is longer than the numbers it joins, so lines are joined first and ended at last.
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    own = dict(zip(docs.columns, from_row(docs, "row"), strict=True))[doc]
    f = found.select(own, "runs", "collapsed", lines.alias("lines"), F.when(F.size("runs") > 0, longest).alias("top"))
    return f.select(
        doc, F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"),
        F.col("top.p").alias("period"), F.floor(F.lit(-1000) * F.col("top.l") / F.col("top.p")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
