"""Alignment of two tokenizers by their shared cuts, and the corpus's counts of linked ids.

A block's texts are cut where a space follows another visible character: neither tokenizer's tokens span such a place,
so each distinct unit is tokenised and aligned once a block. Over the units' bytes a packed bitset marks each
tokenizer's token ends; their AND has the shared cuts, popcounts rank them to token ranges, and links expand from the
ranges. Counts of id pairs are summed over blocks by Spark, and each block meets the counts of its own pairs only.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks_of, give_back, packed, unpacked
from .common import as_row, from_row, quoted, stash

#: Text of a block, in bytes; one longer text is a block.
BLOCK_BYTES = 6 << 20
#: Bytes of units that are tokenised by one call.
CALL_BYTES = 1 << 18
#: Links expanded together; a group of more links than this is counted by its distinct ids.
LINKS = 1 << 22
#: Bits of an id, and of a unit's number, in a packed key.
ID_BITS, UNIT_BITS = 20, 23


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_byte_level(path: str) -> dict[bytes, int]:
    """Bytes of each token of a byte-level BPE file to its id, without added tokens. Merges must stand in the ids' order."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    own, model = byte_alphabet(), whole["model"]
    if model["type"] != "BPE" or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole["pre_tokenizer"]["add_prefix_space"] or whole["normalizer"]:
        raise ValueError("not a plain byte-level BPE")
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        raise ValueError("ids are not in the order of merges")
    added = {t["content"] for t in whole["added_tokens"]}
    return {bytes(own[c] for c in token): i for token, i in model["vocab"].items() if token not in added}


def _piece_bytes(model) -> list[bytes]:
    """Bytes of each piece, U+2581 as space, byte pieces as their byte."""
    out = []
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        out.append(bytes((int(piece[3:5], 16),)) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Tokenizers:
    """Both tokenizers in a worker: ids of units, bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: str) -> None:
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_a: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = _piece_bytes(self.b)
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: No piece has a space after another character, so B's merges never span a unit's beginning.
        self.apart = not any(b" " in p.lstrip(b" ") for p in self.bytes_b)
        # Ids as text, each with either of the two marks that may follow it.
        sized = (str(i) + mark for n, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for mark in marks for i in range(n))
        self.texts = pa.array(sized, pa.large_binary())

    def ids_a(self, units: bytes, ends: np.ndarray) -> np.ndarray:
        """Ids of all units, which stand one after another and end at `ends`; a call takes units between which cuts are sure."""
        data = np.frombuffer(units, np.uint8)
        sure = _visible(data[ends - 1], data[np.maximum(ends - 2, 0)])
        full = ends[np.minimum(np.searchsorted(ends, np.arange(CALL_BYTES, len(data) + CALL_BYTES, CALL_BYTES)), len(ends) - 1)] if len(ends) else ends
        out, at = [np.zeros(0, np.int64)], 0
        for end in np.unique(np.concatenate([ends[~sure], full])).tolist():
            out.append(np.array(self.a.encode_ordinary(units[at:end].decode()), np.int64))
            at = end
        return np.concatenate(out)

    def ids_b(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each unit); the unit's first space is the one that B adds."""
        lists = self.b.encode([u[1:].decode() for u in units], num_threads=1) if units else []
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _visible(byte: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether these bytes surely end a character that is no white space; before: the bytes before them."""
    ascii_one = (byte > 0x20) & (byte < 0x7F)
    # White space beyond ASCII ends in C2 85, C2 A0, 9A 80, 80 80 to 80 AF or 81 9F.
    white = ((before == 0xC2) & ((byte == 0x85) | (byte == 0xA0))) | np.isin(before, (0x80, 0x81, 0x9A)) & (byte <= 0xAF)
    return ascii_one | ((byte >= 0x80) & ~white)


def cut_units(texts: list[str | None], apart: bool) -> tuple[pa.Array, np.ndarray]:
    """(units, units of each text): each text after a space, cut at spaces after visible characters; null and empty have none."""
    whole = [b" " + t.encode() if t else b"" for t in texts]
    sizes = np.array([len(w) for w in whole], np.int64)
    raw = b"".join(whole)
    del whole
    data = np.frombuffer(raw, np.uint8)
    begin = np.cumsum(sizes) - sizes
    starts = np.zeros(len(data), bool)
    if apart and len(data) > 2:
        at = 2 + np.flatnonzero(data[2:] == 0x20)
        starts[at[_visible(data[at - 1], data[at - 2])]] = True
    # A space alone is no unit, for B adds none to an empty text.
    starts[(begin + sizes - 1)[sizes > 0]] = False
    starts[begin[sizes > 0]] = True
    at = np.flatnonzero(starts)
    offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
    units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(raw)])
    return units, np.searchsorted(at, begin + sizes) - np.searchsorted(at, begin)


def _bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """A packed bitset with the bits of these byte offsets set."""
    bits = np.zeros(-(-(size + 1) // 64) * 64, bool)
    bits[ends] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _ranks(words: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many bits are set up to each cut, itself included, by popcounts."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    low = np.uint64(2**64 - 1) >> (np.uint64(63) - (cuts % 64).astype(np.uint64))
    return before[cuts // 64] + np.bitwise_count(words[cuts // 64] & low)


@dataclass
class Aligned:
    """Units aligned one after another. Arrays named of_* hold bounds of each unit's share, one more than units."""

    cuts: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray, unit_ends: np.ndarray) -> Aligned:
    """Shared cuts of two series of token ends (byte offsets, both end at each of unit_ends) and the token ranges they bound.

    ends_a and ends_b of the result: tokens of each up to each cut, where group g has those from the cut before on.
    """
    size = int(unit_ends[-1]) if len(unit_ends) else 0
    a, b = _bitset(ends_a, size), _bitset(ends_b, size)
    both = a & b
    cuts = np.flatnonzero(np.unpackbits(both.view(np.uint8), bitorder="little"))
    upto = lambda words: np.diff(_ranks(words, unit_ends), prepend=0)
    return Aligned(cuts, _ranks(a, cuts), _ranks(b, cuts), upto(a), upto(b), upto(both))


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)


def expand_links(x: Aligned, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, pair, times): the distinct id pairs that each unit links, a << ID_BITS | b, and how often."""
    first_a, first_b = np.append(0, x.ends_a[:-1]), np.append(0, x.ends_b[:-1])
    m, k = x.ends_a - first_a, x.ends_b - first_b
    of = np.repeat(np.arange(len(x.n_groups)), x.n_groups)
    keys, counts = [], []

    def add(key: np.ndarray, times: np.ndarray | None = None) -> None:
        if times is None:
            key, times = np.unique(key, return_counts=True)
        keys.append(key)
        counts.append(times)

    pack = lambda unit, one, two: (unit << 2 * ID_BITS) | (one << ID_BITS) | two
    links = m * k
    for g in np.flatnonzero(links > LINKS).tolist():
        one, n_one = np.unique(a[first_a[g] : x.ends_a[g]], return_counts=True)
        two, n_two = np.unique(b[first_b[g] : x.ends_b[g]], return_counts=True)
        for lo in range(0, len(one), max(1, LINKS // len(two))):
            part = slice(lo, lo + max(1, LINKS // len(two)))
            add(pack(of[g], one[part, None], two[None, :]).ravel(), (n_one[part, None] * n_two[None, :]).ravel())
    rest = np.flatnonzero(links <= LINKS)
    ends, lo = np.cumsum(links[rest]), 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LINKS, "right")))
        g = rest[lo:hi]
        inner, group = _ranges(links[g]), np.repeat(g, links[g])
        add(pack(of[group], a[first_a[group] + inner // k[group]], b[first_b[group] + inner % k[group]]))
        lo = hi
    key, times = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    key, back = np.unique(key, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, times)
    return key >> 2 * ID_BITS, key & ((1 << 2 * ID_BITS) - 1), total


def group_texts(x: Aligned, a: np.ndarray, b: np.ndarray, tok: Tokenizers) -> pa.Array:
    """Each unit's groups as text: a1,a2|b1,b2; with a semicolon after every group."""
    order = np.empty(len(a) + len(b), np.int64)
    last = np.zeros(len(a), np.int64)
    last[x.ends_a - 1] = 1
    n = len(tok.bytes_a)
    # A's tokens of a group stand after B's of the groups before it, B's after A's of the group itself.
    order[np.arange(len(a)) + np.repeat(np.append(0, x.ends_b[:-1]), np.diff(x.ends_a, prepend=0))] = a + n * last
    last = np.zeros(len(b), np.int64)
    last[x.ends_b - 1] = 1
    order[np.arange(len(b)) + np.repeat(x.ends_a, np.diff(x.ends_b, prepend=0))] = 2 * n + b + len(tok.bytes_b) * last
    flat = tok.texts.take(pa.array(order))
    offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    ends = np.append(0, np.cumsum(x.n_a + x.n_b))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets[ends]), flat.buffers()[2]])


def align_block(texts: list[str | None], tok: Tokenizers) -> tuple[dict[str, np.ndarray | list], list[np.ndarray]]:
    """Per text the counts and the digest of its groups; the block's pairs, their documents, and each text's links.

    The second part holds: pairs; documents of each; for each text how many pairs it links; which; how often.
    """
    import hashlib

    units, sizes = cut_units(texts, tok.apart)
    coded = units.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    del units, coded
    lengths = np.array([len(u) for u in distinct], np.int64)
    b, n_b = tok.ids_b(distinct)
    # A unit that B does not give back byte by byte leaves its texts without tokens.
    bad = np.zeros(len(distinct), bool)
    joined = b"".join(map(tok.bytes_b.__getitem__, b.tolist()))
    if joined != b"".join(distinct):
        ends = np.cumsum(n_b)
        for i, (lo, hi) in enumerate(zip((ends - n_b).tolist(), ends.tolist(), strict=True)):
            bad[i] = b"".join(map(tok.bytes_b.__getitem__, b[lo:hi].tolist())) != distinct[i]
        b = b[np.repeat(~bad, n_b)]
    del joined
    good = [u for u, x in zip(distinct, bad.tolist(), strict=True) if not x]
    unit_ends = np.cumsum(lengths[~bad])
    a = tok.ids_a(b"".join(good), unit_ends)
    ends_a, ends_b = np.cumsum(tok.length_a[a]), np.cumsum(tok.length_b[b])
    if len(good) and not (np.isin(unit_ends, ends_a).all() and np.isin(unit_ends, ends_b).all()):
        raise ValueError("a token spans a unit's end")
    x = align(ends_a, ends_b, unit_ends)
    place = np.cumsum(~bad) - 1
    of = np.repeat(np.arange(len(texts)), sizes)
    spoilt = np.bincount(of[bad[codes]], minlength=len(texts)) > 0
    kept = ~spoilt[of]
    of, codes = of[kept], place[codes[kept]]
    if len(good) >= 1 << UNIT_BITS or max(len(tok.bytes_a), len(tok.bytes_b)) > 1 << ID_BITS:
        raise ValueError("a block has more units, or a vocabulary more ids, than a packed key holds")
    unit, pair, times = expand_links(x, a, b)
    links = np.zeros(len(good), np.int64)
    np.add.at(links, unit, times)
    total = lambda v: np.bincount(of, v[codes], len(texts)).astype(np.int64)  # noqa: E731  sums stay below 2**53
    counts = {"n_a": total(x.n_a), "n_b": total(x.n_b), "n_groups": total(x.n_groups), "n_links": total(links)}

    held = group_texts(x, a, b, tok).take(pa.array(codes))
    offsets = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, held.offset * 8)
    data = memoryview(held.buffers()[2]) if len(held) else memoryview(b"")
    bounds = offsets[np.searchsorted(of, np.arange(len(texts) + 1))]
    counts["groups_sha256"] = [hashlib.sha256(data[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    del held, data

    pairs, pair = np.unique(pair, return_inverse=True)
    first = np.searchsorted(unit, np.arange(len(good) + 1))
    key, often = np.unique(of * (len(good) + 1) + codes, return_counts=True)
    doc, code = key // (len(good) + 1), key % (len(good) + 1)
    n = first[code + 1] - first[code]
    at = np.repeat(first[code], n) + _ranges(n)
    key = np.repeat(doc, n) * (len(pairs) + 1) + pair[at]
    by = np.argsort(key, kind="stable")
    key, often = key[by], (np.repeat(often, n) * times[at])[by]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    often = np.add.reduceat(often, head) if len(head) else often
    doc, which = key[head] // (len(pairs) + 1), key[head] % (len(pairs) + 1)
    documents = np.bincount(which, minlength=len(pairs))
    return counts, [pairs, documents.astype(np.int64), np.bincount(doc, minlength=len(texts)).astype(np.int32), which.astype(np.int32), often]


def aligned_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, model: str, text: str = "text") -> DataFrame:
    """docs (all columns, whatever their names, in struct `row`) with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: byte-level BPE by `ranks` and `pattern` of a space and the text; B: the sentencepiece model of that path, which adds
    the space. Links are all pairs of A and B tokens of one group; a pair's count is in how many rows it is linked.
    n_best: links whose count is the highest of their A id, ties included; count_sum: counts summed over links. Null or
    empty texts, and those that B doesn't give back byte by byte, have zeros and an empty digest. Repeated rows and ids
    count as rows. Empty table: empty result.
    """
    rows = docs.select(as_row(docs).alias("row"), quoted(text).cast("string").alias("text"))
    row = rows.schema["row"].dataType
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        for block, part in blocks_of(batches, 1, BLOCK_BYTES):
            tok = tok or Tokenizers(ranks, pattern, model)
            counts, links = align_block(part.column("text").to_pylist(), tok)
            own = pa.table([part.column("row").combine_chunks(), *[pa.array(counts[c]) for c in names]], names=["row", *names])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *[pa.array([v], pa.binary()) for v in (sink.getvalue().to_pybytes(), packed(*links[:2]), packed(*links[2:]))]],
                ["block", "rows", "pairs", "links"],
            )
            give_back()

    blocks = stash(rows.mapInArrow(one, "block long, rows binary, pairs binary, links binary"), "aligned")

    def list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pair, n = unpacked(blob, np.int64, np.int64)
                for lo in range(0, len(pair), 1 << 16):
                    p = pair[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), block)), pa.array(np.arange(lo, lo + len(p), dtype=np.int32)), pa.array((p >> ID_BITS).astype(np.int32)),
                         pa.array((p & ((1 << ID_BITS) - 1)).astype(np.int32)), pa.array(n[lo : lo + len(p)])],
                        ["block", "no", "a", "b", "n"],
                    )

    pairs = blocks.select("block", "pairs").mapInArrow(list_pairs, "block long, no int, a int, b int, n long")
    counts = stash(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    # At most a row for each of A's ids.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("highest")))
    counts = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = pairs.drop("n").join(counts, ["a", "b"]).select("block", "no", "count", "best")

    fields = [T.StructField("row", row)] + [T.StructField(c, T.LongType()) for c in (*names[:4], "n_best", "count_sum")] + [T.StructField(names[4], T.StringType())]

    def two(own: pa.Table, answers: pa.Table) -> pa.Table:
        n = answers.num_rows
        count, best, no = np.zeros(n, np.int64), np.zeros(n, np.int64), answers.column("no").to_numpy()
        count[no], best[no] = answers.column("count").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False)
        out = []
        for blob, links in zip(own.column("rows").to_pylist(), own.column("links").to_pylist(), strict=True):
            t = pa.ipc.open_stream(blob).read_all().combine_chunks()
            sizes, which, often = unpacked(links, np.int32, np.int32, np.int64)
            edge = np.append(0, np.cumsum(sizes, dtype=np.int64))
            summed = lambda v: np.diff(np.append(0, np.cumsum(v))[edge])
            t = t.append_column("n_best", pa.array(summed(often * best[which]))).append_column("count_sum", pa.array(summed(often * count[which])))
            out.append(t.select([f.name for f in fields]))
        give_back()
        return pa.concat_tables(out)

    return blocks.select("block", "rows", "links").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(two, T.StructType(fields))


def alignment_report(found: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    own = dict(zip(docs.columns, from_row(docs, "row"), strict=True))[doc]
    return found.select(own, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
