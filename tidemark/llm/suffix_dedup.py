"""Suffix dedup: bytes that stand in a 50-byte string of an earlier document are removed.

A block of documents cuts its windows of 50 bytes into runs that share their least 24-byte piece, by hash (the anchor).
Equal windows have equal anchors, so windows are only compared within an anchor's part, and only where its anchor
occurs in two documents at all: sorted anchor lists of the blocks are merged by binary search first. In a part the
suffixes that begin a window are put in order by refining groups of equal prefixes, 8 bytes at a time up to 50;
neighbours that stay in one group have a common prefix of 50 bytes, and the least document of a group is its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks_of, numbers, packed, parts_for, planes, received, same_on_every_reading, shipped, unpacked

LENGTH = 50
ANCHOR = 24
BLOCK_BYTES = 6 << 20
#: Text whose anchors are dealt to one part.
PART_BYTES = 8 << 20
#: Low bits of an anchor's value that hold its place in the block; a block's texts must be shorter.
PLACE_BITS = 31


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Block:
    """The texts of a block end to end. Rows without an id or a text have no windows."""

    def __init__(self, texts: list[str | None], ids: list[int | None]) -> None:
        raw = [(t or "").encode() for t in texts]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = b"".join(raw)
        self.known = np.array([i is not None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, anchor, doc): windows from first to last start that share an anchor; doc: place of the document."""
        n = len(self.data)
        if n < LENGTH:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty(0, np.int64))
        buf = self.data + bytes(16)
        word = np.ndarray(n, "<u8", buf, strides=(1,)) if n else np.empty(0, np.uint64)
        k = n - ANCHOR + 1
        h = word[:k] * np.uint64(0x9E3779B97F4A7C15)
        h ^= _mix(word[8 : 8 + k])
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= word[16 : 16 + k] * np.uint64(0x165667B19E3779F9)
        h = _mix(h)
        low = np.uint64((1 << PLACE_BITS) - 1)
        # The place breaks ties to the left, and tells where the least one stands.
        h = (h & ~low) | np.arange(k, dtype=np.uint64)
        wide, span = 1, LENGTH - ANCHOR + 1
        while 2 * wide <= span:
            h = np.minimum(h[:-wide], h[wide:])
            wide *= 2
        m = n - LENGTH + 1
        h = np.minimum(h[:m], h[span - wide : span - wide + m])
        edge = np.zeros(n + 1, np.int8)
        own = np.flatnonzero((self.sizes >= LENGTH) & self.known)
        edge[self.starts[own]] += 1
        edge[self.starts[own] + self.sizes[own] - LENGTH + 1] -= 1
        inside = np.cumsum(edge[:m], dtype=np.int8).view(bool)
        new = inside.copy()
        new[1:] &= ((h[1:] & low) != (h[:-1] & low)) | ~inside[:-1]
        first = np.flatnonzero(new)
        stop = inside.copy()
        stop[:-1] &= new[1:] | ~inside[1:]
        last = np.flatnonzero(stop)
        return first, last, h[first] >> np.uint64(PLACE_BITS), np.searchsorted(self.starts, first, "right") - 1


def _doc_of(block: Block, doc: np.ndarray) -> np.ndarray:
    """Empty texts share their start with the next, so the place found is that of the last of them: the one with bytes."""
    return block.ids[doc]


def _by_part(values: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    part = (values % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    there, begin = np.unique(part[order], return_index=True)
    edges = [*begin.tolist(), len(order)]
    for p, a, b in zip(there.tolist(), edges, edges[1:], strict=False):
        yield p, order[a:b]


def _anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct anchors in order, and whether two of its documents have them."""
    _, _, anchor, doc = block.runs()
    order = np.lexsort((doc, anchor))
    a, d = anchor[order], doc[order]
    head = np.ones(len(a), bool)
    head[1:] = a[1:] != a[:-1]
    at = np.flatnonzero(head)
    tail = np.append(at[1:], len(a)) - 1
    return a[at], d[at] != d[tail[: len(at)]]


def _emit(rows: list[tuple[int, int, bytes]], names: list[str]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names)


def _anchor_lists(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in blocks_of(batches, 0, BLOCK_BYTES):
            anchor, several = _anchors(Block(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
            yield _emit(
                [(p, number, packed(planes(np.diff(anchor[own], prepend=np.uint64(0))), several[own])) for p, own in _by_part(anchor, parts)],
                ["part", "block", "blob"],
            )

    return docs.mapInArrow(run, "part long, block long, blob binary")


def _shared_anchors(rows: pa.Table) -> pa.Table:
    """Per block of a part, a bit for each of its anchors: another document has it."""
    got = [unpacked(b, np.uint8, bool) for b in rows.column("blob").to_pylist()]
    lists = [np.cumsum(numbers(x, np.uint64), dtype=np.uint64) for x, _ in got]
    merged = np.sort(np.concatenate(lists))
    again = merged[1:][merged[1:] == merged[:-1]]
    out = []
    for own, (_, several) in zip(lists, got, strict=True):
        at = np.searchsorted(again, own)
        found = np.zeros(len(own), bool) if not len(again) else again[np.minimum(at, len(again) - 1)] == own
        out.append(np.packbits(found | several).tobytes())
    return pa.table([rows.column("block"), rows.column("part"), pa.array(out, pa.binary())], names=["block", "part", "blob"])


def _strings(docs: pa.Table, bits: pa.Table, parts: int) -> pa.Table:
    """(part, block, blob): a block's distinct run texts with a shared anchor: first run, least and greatest document."""
    out = []
    number = docs.column("block")[0].as_py()
    flags = dict(zip(bits.column("part").to_pylist(), bits.column("blob").to_pylist(), strict=True))
    for rows in received(docs):
        block = Block(rows.column(0).to_pylist(), rows.column(1).to_pylist())
        anchors, _ = _anchors(block)
        keep = np.zeros(len(anchors), bool)
        for p, own in _by_part(anchors, parts):
            if p in flags:
                keep[own] = np.unpackbits(np.frombuffer(flags[p], np.uint8), count=len(own)).astype(bool)
        first, last, anchor, doc = block.runs()
        at = np.flatnonzero(keep[np.searchsorted(anchors, anchor)]) if len(anchors) else np.empty(0, np.int64)
        seen: dict[bytes, int] = {}
        data = block.data
        code = np.array([seen.setdefault(data[s : e + LENGTH], len(seen)) for s, e in zip(first[at].tolist(), last[at].tolist(), strict=True)], np.int64)
        ids = _doc_of(block, doc[at])
        least, most = np.full(len(seen), np.iinfo(np.int64).max), np.full(len(seen), np.iinfo(np.int64).min)
        np.minimum.at(least, code, ids)
        np.maximum.at(most, code, ids)
        run = np.zeros(len(seen), np.int64)
        run[code[::-1]] = at[::-1]
        texts = list(seen)
        for p, own in _by_part(anchor[run], parts):
            body = b"".join([texts[i] for i in own.tolist()])
            sizes = np.array([len(texts[i]) for i in own.tolist()], np.uint8)
            out.append((p, number, packed(np.frombuffer(body, np.uint8), sizes, planes(run[own]), planes(least[own]), planes(most[own]))))
    return pa.Table.from_batches([_emit(out, ["part", "block", "blob"])])


def window_order(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes at the given places in order of their first `length` bytes; equal ones share a group.

    Groups of equal prefixes are refined by the next 8 bytes; those of one suffix are done and take no more part.
    data must hold 8 bytes beyond the last suffix's length.
    """
    word = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    first = word[at].astype(np.uint64)
    order = np.argsort(first)
    first = first[order]
    head = np.ones(len(at), bool)
    head[1:] = first[1:] != first[:-1]
    depths = [*range(8, length - 7, 8)]
    if length % 8:
        depths.append(length - 8)
    for depth in depths:
        alone = head.copy()
        alone[:-1] &= head[1:]
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        group = np.cumsum(head)[todo].astype(np.uint64)
        key = word[at[order[todo]] + depth].astype(np.uint64)
        # One number of the group and the word's rank: two plain sorts take less than a sort by two keys.
        by = np.argsort(key)
        rank = np.empty(len(key), np.uint64)
        rank[by] = np.cumsum(np.diff(key[by], prepend=key[by[:1]]) != 0)
        by = np.argsort((group << np.uint64(32)) | rank)
        order[todo] = order[todo][by]
        key, group = key[by], group[by]
        new = np.ones(len(todo), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        head[todo] = new
    return order, np.cumsum(head) - 1


def _sources(rows: pa.Table) -> pa.Table:
    """(block, part, blob): windows that an earlier document has, as (run, offset, windows, source) of the blocks' texts."""
    got = [unpacked(b, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8) for b in rows.column("blob").to_pylist()]
    sizes = np.concatenate([x[1] for x in got]).astype(np.int64)
    run, least, most = (np.concatenate([numbers(x[i], np.int64) for x in got]) for i in (2, 3, 4))
    owner = np.repeat(np.arange(len(got)), [len(x[1]) for x in got])
    # Equal texts of several blocks are one.
    body, ends = b"".join(x[0].tobytes() for x in got), np.cumsum(sizes)
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(body[a:b], len(seen)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64)
    first, last = np.full(len(seen), np.iinfo(np.int64).max), np.full(len(seen), np.iinfo(np.int64).min)
    np.minimum.at(first, code, least)
    np.maximum.at(last, code, most)
    own = np.fromiter(map(len, seen), np.int64, len(seen))
    body = np.frombuffer(b"".join(seen) + bytes(8), np.uint8)
    windows = own - LENGTH + 1
    text = np.repeat(np.arange(len(own)), windows)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, group = window_order(body, np.repeat(np.cumsum(own) - own, windows) + offset)
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    source = np.empty(len(text), np.int64)
    source[order] = np.minimum.reduceat(first[text[order]], heads)[group] if len(text) else 0
    hit = np.flatnonzero(source < last[text])
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(text[hit]) != 0) | (np.diff(source[hit]) != 0)
    begin = hit[new]
    count = np.diff(np.append(np.flatnonzero(new), len(hit)))
    # Each block's text with all stretches of its kind that have an earlier source.
    edge = np.searchsorted(text[begin], np.arange(len(own) + 1))
    times = (edge[1:] - edge[:-1])[code]
    row = np.repeat(np.arange(len(code)), times)
    at = edge[code[row]] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    later = source[begin[at]] < most[row]
    row, at = row[later], at[later]
    out = []
    part = rows.column("part")[0].as_py()
    edges = np.searchsorted(owner[row], np.arange(len(got) + 1))
    for i, number in enumerate(rows.column("block").to_pylist()):
        r, k = row[edges[i] : edges[i + 1]], at[edges[i] : edges[i + 1]]
        if len(r):
            out.append((number, part, packed(*(planes(x.astype(np.int64)) for x in (run[r], offset[begin[k]], count[k], source[begin[k]])))))
    return pa.Table.from_batches([_emit(out, ["block", "part", "blob"])])


def _removed(docs: pa.Table, found: pa.Table) -> pa.Table:
    """(id, n_bytes, n_removed, n_spans, kept) of a block's documents."""
    out = []
    hits = [unpacked(b, *[np.uint8] * 4) for b in found.column("blob").to_pylist()]
    run, offset, count, source = (
        np.concatenate([numbers(x[i], np.int64) for x in hits]) if hits else np.empty(0, np.int64) for i in range(4)
    )
    for rows in received(docs):
        block = Block(rows.column(0).to_pylist(), rows.column(1).to_pylist())
        data, n = block.data, len(block.data)
        gone = np.zeros(n, bool)
        if len(run):
            first, last, _, doc = block.runs()
            order = np.argsort(run, kind="stable")
            reps, begin = np.unique(run[order], return_index=True)
            sizes = np.diff(np.append(begin, len(run)))
            known = {data[first[r] : last[r] + LENGTH]: i for i, r in enumerate(reps.tolist())}
            code = np.array([known.get(data[s : e + LENGTH], -1) for s, e in zip(first.tolist(), last.tolist(), strict=True)], np.int64)
            same = np.flatnonzero(code >= 0)
            times = sizes[code[same]]
            each = np.repeat(same, times)
            inner = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            hit = order[begin[code[each]] + inner]
            later = source[hit] < _doc_of(block, doc[each])
            start = first[each[later]] + offset[hit[later]]
            end = start + count[hit[later]] - 1 + LENGTH
            gone = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        nonempty = block.sizes > 0
        opens[block.starts[nonempty]] = gone[block.starts[nonempty]]
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        removed, spans = upto(gone), upto(opens)
        a, b = block.starts, block.starts + block.sizes
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
        stay = a - removed[a], b - removed[b]
        out.append(pa.table(
            [rows.column(1).combine_chunks(), pa.array(block.sizes), pa.array(removed[b] - removed[a]), pa.array(spans[b] - spans[a]),
             pa.array([kept[x:y] for x, y in zip(*(s.tolist() for s in stay), strict=True)], pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        ))
    return pa.concat_tables(out)


def suffix_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept binary) per row.

    A byte goes if it stands in a 50-byte string that also starts in a document of smaller id; overlaps count, and the
    input decides, not what is left. Null texts are empty; texts under 50 bytes and rows without an id are whole, and are
    no source. Rows of one id don't take from each other. A block sends each distinct string once, whatever its copies.
    """
    d = same_on_every_reading(docs.select(F.col(text).cast("string").alias("text"), F.col(doc).cast("long").alias("id")))
    parts = parts_for(d, "text", PART_BYTES)
    three = "part long, block long, blob binary"
    bits = _anchor_lists(d, parts).groupBy("part").applyInArrow(_shared_anchors, "block long, part long, blob binary")
    blocks = shipped(d, BLOCK_BYTES)
    strings = blocks.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(lambda a, b: _strings(a, b, parts), three)
    found = strings.groupBy("part").applyInArrow(_sources, "block long, part long, blob binary")
    kept = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _removed, "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return kept.withColumnRenamed("id", doc)
