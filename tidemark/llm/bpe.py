"""Byte-level BPE encoding and decoding.

Texts are cut into pieces by the vocabulary's pattern; a piece that is a token needs no merges. The other distinct
pieces of the corpus are folded once each by Spark higher-order functions, from their bytes on, which look up ranks of
joined pairs in a map that is read once, as a scalar subquery, and reaches tasks as a literal: plans stay small whatever
the vocabulary.
A block of documents then meets the ids of its own pieces only, so no dictionary grows with the corpus.
Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks_of, give_back, packed, parts_for, received, same_on_every_reading, shipped, unpacked
from .common import quoted

#: Text of a block, in bytes. A block's texts and pieces are in one task's memory together; one longer text is a block.
BLOCK_BYTES = 12 << 20
#: Longer pieces (runs without a word's shape) are merged with a heap in the worker, for a fold is quadratic in their length.
FOLD_BYTES = 60
#: Pieces that are folded in one row, which holds them and the rank map together.
FOLD_ROWS = 2048
#: Text whose pieces are dealt to one part.
PART_BYTES = 8 << 20
#: Patterns by which a space before a word is part of the word's piece, and nothing else spans it: texts are cut at
#: such spaces first. By any other pattern each text is cut whole. Fixed values.
SPACED_PATTERNS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)
#: White space as Unicode's property has it; the regex library's \s counts separators 1C to 1F too.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def portable(pattern: str) -> str:
    """The pattern with white space spelled out, and with ends that are the text's own, as the tokenizer library has them."""
    out, inside, at = [], 0, 0
    while at < len(pattern):
        one = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(one)
        if one == "\\s":
            one = WHITE if inside else f"[{WHITE}]"
        elif one == "\\S":
            if inside:
                raise ValueError(r"\S within a class has no portable form")
            one = f"[^{WHITE}]"
        elif one == "$" and not inside:
            one = r"\Z"
        inside += (one == "[") - (one == "]" and inside > 0)
        out.append(one)
    return "".join(out)


def cutter(pattern: str) -> Callable[[str], list[bytes]]:
    import regex

    find = regex.compile(portable(pattern)).findall
    return lambda unit: [x.encode() for x in find(unit)]


_BREAK = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> tuple[str, list[str]]:
    """The text before its first break, and what follows each break. A break is a space between two other characters.

    No piece spans a break from the left, and the space begins a piece with what follows it, so units are cut alike
    wherever they stand.
    """
    first, *rest = _BREAK.split(text)
    return first, rest


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by a heap of neighbouring pairs: least rank first, leftmost among equals."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, ahead = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts):
            both = parts[i] + parts[after[i]]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], i, both))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
            continue
        gone = after[i]
        parts[i], parts[gone], after[i] = both, None, after[gone]
        if after[gone] < len(parts):
            ahead[after[gone]] = i
        offer(i)
        offer(ahead[i])
    return [ranks[x] for x in parts if x is not None]


def byte_ids(ranks: dict[bytes, int]) -> list[int]:
    """The id of each single byte; a byte-level vocabulary has them all."""
    return [ranks[bytes((b,))] for b in range(256)]


def byte_pairs(ranks: dict[bytes, int]) -> list[tuple[int, int]]:
    """(place, rank) of every token of two bytes; its place is that of the pair among all 65,536."""
    return [(token[0] << 8 | token[1], rank) for token, rank in ranks.items() if len(token) == 2]


#: Slots of the rank map, and the factor that spreads pairs over them.
SLOTS, SPREAD = 1 << 17, 40503


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """array<map<bigint, int>>: by slot, the rank of every pair of tokens that join to a token; a scalar subquery."""
    slots: list[dict[int, int]] = [{} for _ in range(SLOTS)]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                slots[(a * SPREAD + b) & (SLOTS - 1)][a << 32 | b] = rank
    one = spark.createDataFrame([(json.dumps(slots, separators=(",", ":")),)], "ranks string").select(F.from_json("ranks", "array<map<string,int>>").alias("ranks"))
    return one.select(F.transform("ranks", lambda m: F.transform_keys(m, lambda k, _: k.cast("bigint"))).alias("ranks")).scalar()


def rank_lookup(slots: Column) -> Callable[[Column, Column], Column]:
    """Rank of two tokens joined, null where they are no token or one is missing."""
    def rank(a: Column, b: Column) -> Column:
        slot = (a * F.lit(SPREAD).cast("bigint") + b).bitwiseAND(F.lit(SLOTS - 1).cast("bigint")).cast("int")
        return F.try_element_at(F.get(slots, slot), a * F.lit(1 << 32) + b)

    return rank


#: The rank of a pair that joins to no token.
NO_RANK = 2**31 - 1


def fold_merges(first: Column, rank: Callable[[Column, Column], Column]) -> Column:
    """Ids of a piece from its bytes on, folded by joining the pair of least rank, leftmost first, until none has one.

    The state, which starts as `first`, is a struct of the parts' ids and the `ranks` of each part joined to the next,
    NO_RANK where that is no token and for the last; a joined pair's id is its rank.
    """
    none = F.lit(NO_RANK)
    # The one-element transforms name a value, so that it is computed once.
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    pair = lambda ids, i: F.coalesce(rank(F.get(ids, i - 1), F.get(ids, i)), none)  # noqa: E731  the i-th part, from 1, and the next

    def merged(state: Column, k: Column, least: Column) -> Column:
        old = state["ranks"]
        ids = F.concat(F.slice(state["ids"], F.lit(1), k - 1), F.array(least), F.slice(state["ids"], k + 2, F.size(old)))
        around = F.when(k > 1, F.array(k - 1, k)).otherwise(F.array(k))
        return let(ids, lambda now: F.struct(
            now.alias("ids"),
            F.concat(F.slice(old, F.lit(1), F.greatest(k - 2, F.lit(0))), F.transform(around, lambda i: pair(now, i)), F.slice(old, k + 2, F.size(old))).alias("ranks"),
        ))

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state["ranks"]), lambda least: F.when(least == none, state).otherwise(
            let(F.array_position(state["ranks"], least).cast("int"), lambda k: merged(state, k, least))))

    size = F.size(first["ids"])
    rounds = F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, first, step, lambda s: s["ids"])


def _put(items: list[bytes]) -> bytes:
    """Byte strings of under 256 bytes, each after its length, compressed."""
    import zstandard

    return zstandard.compress(b"".join(bytes((len(x),)) + x for x in items), 3)


def _taken(blob: bytes) -> Iterator[bytes]:
    import zstandard

    data, at = zstandard.decompress(blob), 0
    while at < len(data):
        end = at + 1 + data[at]
        yield data[at + 1 : end]
        at = end


class Units:
    """A block's texts as units by number.

    Units are split and numbered by Arrow; the rare texts with other white space than single spaces between words are
    cut one by one. Entries are, in this order: what follows a space, each distinct; texts' beginnings; odd texts.
    By a pattern that is not spaced every text is odd, and is cut whole.
    """

    def __init__(self, texts: pa.Array, spaced: bool) -> None:
        import numpy as np
        import pyarrow.compute as pc

        self.spaced = spaced
        if not spaced:
            self.after, self.begin, self.odd = pa.array([], pa.string()), [], [t or "" for t in texts.to_pylist()]
            self.codes, self.sizes = np.arange(len(self.odd)), np.ones(len(self.odd), np.int64)
            return
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        starts = lists.offsets.to_numpy()[:-1]
        coded = lists.flatten().dictionary_encode()
        self.after = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int64)
        edge = [pc.utf8_is_space(pc.utf8_slice_codeunits(self.after, *at)) for at in ((0, 1), (-1, None))]
        odd_unit = pc.or_(pc.equal(self.after, ""), pc.or_(*edge)).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(odd_unit[codes], starts) if len(starts) else np.empty(0, bool)
        k = len(self.after)
        firsts, place = np.unique(codes[starts], return_inverse=True)
        self.begin = [self.after[i].as_py() for i in firsts.tolist()]
        self.odd = [texts[i].as_py() or "" for i in np.flatnonzero(odd).tolist()]
        codes[starts] = k + place
        codes[starts[odd]] = k + len(firsts) + np.arange(len(self.odd))
        sizes = np.diff(np.append(starts, len(codes)))
        keep = ~np.repeat(odd, sizes)
        keep[starts] = True
        #: Entries of the texts one after another, and how many each has.
        self.codes, self.sizes = codes[keep], np.where(odd, 1, sizes)

    def _kinds(self) -> tuple[pa.Array, pa.Array]:
        """Which of `after` are a word, and which a word and a stop."""
        import pyarrow.compute as pc

        return pc.match_substring_regex(self.after, r"^\pL+$"), pc.match_substring_regex(self.after, r"^\pL+[.,]$")

    def _others(self, cut: Callable[[str], list[bytes]]) -> Iterator[list[bytes]]:
        """Pieces of the beginnings and of the odd texts, each in turn."""
        for u in self.begin:
            yield cut(u)
        for text in self.odd:
            first, rest = units(text) if self.spaced else (text, [])
            yield [p for v in (first, *(" " + r for r in rest)) for p in cut(v)]

    def unknown(self, cut: Callable[[str], list[bytes]], known: pa.Array) -> list[bytes]:
        """Distinct pieces that are no tokens and short enough to fold, in order."""
        import pyarrow.compute as pc

        word, stop = self._kinds()
        words = pa.concat_arrays([self.after.filter(word), pc.utf8_slice_codeunits(self.after.filter(stop), 0, -1)])
        words = pc.unique(pc.binary_join_element_wise(pa.scalar(" "), words, pa.scalar("")).cast(pa.binary()))
        # Cut as one text: units are cut alike wherever they stand, and pieces of those of odd texts come with these texts.
        rest = set(cut(" " + " ".join(self.after.filter(pc.invert(pc.or_(word, stop))).to_pylist())))
        rest.update(p for own in self._others(cut) for p in own)
        found = pc.unique(pa.concat_arrays([words, pa.array(list(rest), pa.binary())]))
        found = found.filter(pc.and_(pc.invert(pc.is_in(found, value_set=known)), pc.less_equal(pc.binary_length(found), FOLD_BYTES)))
        return found.take(pc.array_sort_indices(found)).to_pylist()

    def coded(self, cut: Callable[[str], list[bytes]], at: dict[bytes, bytes], long: Callable[[bytes], bytes]) -> list[bytes]:
        """The packed ids of each entry, in turn; long: of a piece that was not folded."""
        import pyarrow.compute as pc

        import numpy as np

        word, stop = self._kinds()
        spaced = pc.binary_join_element_wise(pa.scalar(" "), self.after, pa.scalar("")).cast(pa.binary())
        of = lambda pieces: b"".join([at[p] if p in at else long(p) for p in pieces])
        made = np.empty(len(spaced), object)

        def fill(mask: pa.Array, values: list[bytes]) -> None:
            made[np.flatnonzero(mask.to_numpy(zero_copy_only=False))] = np.fromiter(values, object, len(values))

        words = spaced.filter(word).to_pylist()
        fill(word, [long(u) if x is None else x for u, x in zip(words, map(at.get, words), strict=True)])
        fill(stop, [of((u[:-1], u[-1:])) for u in spaced.filter(stop).to_pylist()])
        other = pc.invert(pc.or_(word, stop))
        fill(other, [of(cut(" " + u)) for u in self.after.filter(other).to_pylist()])
        return [*made.tolist(), *map(of, self._others(cut))]


def _dealt(pieces: list[bytes], parts: int) -> dict[int, list[bytes]]:
    """Pieces by part, those of a part in their order."""
    out: dict[int, list[bytes]] = {}
    for p in pieces:
        out.setdefault(zlib.crc32(p) % parts, []).append(p)
    return out


def _pieces(docs: DataFrame, known: list[bytes], pattern: str, parts: int) -> DataFrame:
    """(part, block, blob): a block's distinct pieces that are no tokens and short enough to fold, dealt by CRC-32."""
    spaced = pattern in SPACED_PATTERNS

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, tokens = cutter(pattern), pa.array(known, pa.binary())
        for block, rows in blocks_of(batches, 0, BLOCK_BYTES):
            dealt = _dealt(Units(rows.column(0).combine_chunks(), spaced).unknown(cut, tokens), parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(dealt), pa.int32()), pa.array([block] * len(dealt), pa.int64()), pa.array(map(_put, dealt.values()), pa.binary())],
                ["part", "block", "blob"],
            )
            give_back()

    return docs.select("__text").mapInArrow(find, "part int, block long, blob binary")


def _folded(pieces: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, blob): the ids of a block's pieces of one part. Each distinct piece is folded once.

    A part holds a share of the distinct pieces, each with at most one row per block, never one per occurrence.
    """

    single, double = byte_ids(ranks), byte_pairs(ranks)

    def meet(rows: pa.Table) -> pa.Table:
        """Rows of FOLD_ROWS distinct pieces as ids of their bytes and ranks of neighbours, and the blocks that have each, packed."""
        import numpy as np

        of_byte, of_pair = np.array(single, np.int32), np.full(1 << 16, NO_RANK, np.int32)
        of_pair[[place for place, _ in double]] = [rank for _, rank in double]
        seen: dict[bytes, int] = {}
        codes = [np.array([seen.setdefault(p, len(seen)) for p in _taken(b)], np.int64) for b in rows.column("blob").to_pylist()]
        sizes = [len(c) for c in codes]
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[order], np.arange(len(seen) + 1))
        block = np.repeat(rows.column("block").to_numpy(), sizes)[order]
        cuts = [*range(0, len(seen), FOLD_ROWS), len(seen)]
        owners = [packed(np.diff(ends[i : j + 1]).astype(np.int64), block[ends[i] : ends[j]]) for i, j in zip(cuts, cuts[1:], strict=False)]
        begin = np.cumsum([0, *map(len, seen)])
        flat = np.frombuffer(b"".join(seen), np.uint8)
        beside = np.append(of_pair[flat[:-1].astype(np.uint16) << 8 | flat[1:]], np.int32(NO_RANK))
        beside[begin[1:] - 1] = NO_RANK
        ids, near = (pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x)) for x in (of_byte[flat], beside))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([ids, near], ["ids", "ranks"]))
        out = pa.table([lists, pa.array(owners, pa.binary())], names=["pieces", "owners"])
        del seen, codes, code, order
        give_back()
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's pieces by block."""
        import numpy as np

        for batch in batches:
            out = []
            for owners, ids in zip(*(batch.column(i) for i in range(2)), strict=True):
                count, blocks = unpacked(owners.as_py(), np.int64, np.int64)
                order = np.argsort(blocks, kind="stable")
                row, block = np.repeat(np.arange(len(count)), count)[order], blocks[order]
                values, ends = ids.values.flatten().to_numpy().astype(np.uint32), np.cumsum(np.diff(ids.values.offsets.to_numpy()), dtype=np.int64)
                length = np.diff(ends, prepend=0)
                size = length[row]
                upto = np.cumsum(size)
                flat = values[np.repeat((ends - length)[row] - upto + size, size) + np.arange(int(size.sum()))]
                begin = upto - size
                new = np.flatnonzero(np.diff(block, prepend=-1) != 0)
                for i, j in zip(new.tolist(), [*new[1:].tolist(), len(row)], strict=True):
                    out.append((int(block[i]), packed(size[i:j].astype(np.uint8), flat[begin[i] : upto[j - 1]])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.binary()))], ["block", "blob"])
        give_back()

    distinct = pieces.groupBy("part").applyInArrow(meet, "pieces array<struct<ids:array<int>,ranks:array<int>>>, owners binary")
    # The map is a column of these rows, each with many pieces: a subquery can't stand within a higher-order function.
    rows = distinct.select("owners", "pieces", rank_map(pieces.sparkSession, ranks).alias("ranks"))
    ids = F.transform("pieces", lambda p: fold_merges(p, rank_lookup(F.col("ranks"))))
    return rows.select("owners", ids.alias("ids")).mapInArrow(pack, "block long, blob binary")


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """docs without `text`, with `ids` array<int>: what encode_ordinary of the same vocabulary gives for the whole text.

    Null or empty texts have no ids. Any other columns are carried, whatever their names; rows are independent, so
    repeated rows and ids, or nulls in them, need no care. Empty table: empty result. The rows are read twice, once for
    the pieces and once for the ids; a frame that shuffles is written to the shared folder first, so that both
    readings have the same blocks, and a piece that differs between them all the same is merged by the worker. Blocks travel
    compressed. By a pattern that is not among SPACED_PATTERNS texts are cut whole, which takes longer. decoded: name of
    a further column with the ids' bytes, made by the same worker.
    """
    carried = [c for c in docs.columns if c != text]
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(carried)]) if carried else F.struct(F.lit(0).alias("c0"))
    docs = same_on_every_reading(docs.select(quoted(text).cast("string").alias("__text"), row.alias("__row")))
    parts, spaced = parts_for(docs, "__text", PART_BYTES), pattern in SPACED_PATTERNS
    words = _folded(_pieces(docs, list(ranks), pattern, parts), ranks)
    fields = [T.StructField("__row", docs.schema["__row"].dataType), T.StructField(ids, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded, T.BinaryType())] if decoded else []

    def assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        import numpy as np

        tables, token = [], {v: k for k, v in ranks.items()}
        by_id = pa.array([token.get(i, b"") for i in range(max(token, default=-1) + 1)], pa.binary())
        long = lambda p: np.array(merge_long(p, ranks), np.int32).tobytes()
        for rows in received(docs):
            units = Units(rows.column("__text").combine_chunks(), spaced)
            at = {k: struct.pack("<i", v) for k, v in ranks.items()}
            for blob in words.column("blob").to_pylist():
                # The ids of a piece tell its bytes.
                lengths, values = unpacked(blob, np.uint8, np.int32)
                raw, ends = values.tobytes(), np.append(0, np.cumsum(lengths, dtype=np.int64))
                own = _bytes_of(pa.array(values), ends, by_id).to_pylist()
                at.update((p, raw[a:b]) for p, a, b in zip(own, (ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist(), strict=True))
            made = units.coded(cutter(pattern), at, long)
            del at
            values, ends = _laid_out(made, units.codes, units.sizes)
            del made, units
            out = [rows.column("__row").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends), values)]
            out += [_bytes_of(values, ends, by_id)] if decoded else []
            del values
            tables.append(pa.table(out, names=[f.name for f in fields]))
        del rows
        give_back()
        return pa.concat_tables(tables)

    done = shipped(docs, BLOCK_BYTES).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(assemble, T.StructType(fields))
    return done.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(carried)], *[f.name for f in fields[1:]])


def _laid_out(made: list[bytes], codes, sizes):
    """The ids of a block's texts one after another, and where each text's end, after a 0; made: of each entry, codes and sizes: of Units.

    Arrow takes the entries' lists; an index of all ids would hold 8 bytes of each several times.
    """
    import numpy as np

    begin = np.cumsum([0, *(len(x) // 4 for x in made)], dtype=np.int32)
    entries = pa.ListArray.from_arrays(pa.array(begin), pa.array(np.frombuffer(b"".join(made), np.int32)))
    whole = entries.take(pa.array(codes))
    return whole.values, whole.offsets.to_numpy()[np.append(0, np.cumsum(sizes))]


def _bytes_of(values: pa.Array, ends, by_id: pa.Array) -> pa.Array:
    """The concatenated tokens of each list of ids; ends: where lists end, after a 0. Arrow lays taken tokens end to end."""
    import numpy as np

    taken = by_id.take(values)
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int32, len(taken) + 1)[ends]
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), data])


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the bytes of its ids; null ids give null."""
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {v: k for k, v in ranks.items()}
        for batch in batches:
            out = []
            for x in batch.column(batch.schema.get_field_index(ids)):
                out.append(None if not x.is_valid else b"".join(map(token.__getitem__, x.values.to_numpy().tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, into])

    return df.mapInArrow(join, schema)


def ids_text(ids: str = "ids") -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",")
