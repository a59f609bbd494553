"""Token ids packed into fixed rows by best-fit decreasing, with a segment tree over free capacities.

Documents longer than a row are cut into full rows and a rest, without loss. Documents are dealt to bins by a digest of
their id, so each bin packs on its own; the last, partly filled rows of a bin are all that this costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import packed, same_on_every_reading, unpacked

ROW = 2048
PAD = 50256
#: Tokens of a bin, about; a bin is in one task's memory.
BIN_TOKENS = 2_000_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(row of each piece, rows). Longest first; each goes to the row with least room that still holds it.

    The tree's leaves are the possible amounts of free room, 0 to capacity, its nodes say whether any row below has
    that room; the search for the least leaf from a piece's length on is logarithmic in the capacity.
    """
    width = 1 << capacity.bit_length()
    count = [0] * (2 * width)  # rows below each node
    open_rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def change(room: int, by: int) -> None:
        node = room + width
        while node:
            count[node] += by
            node >>= 1

    def least_from(room: int) -> int:
        """The least free room of any row that is `room` or more, or -1."""
        node = room + width
        if count[node]:
            return room
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < width:
                    node = 2 * node + (not count[2 * node])
                return node - width
            node >>= 1
        return -1

    rows = np.empty(len(lengths), np.int64)
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        room = least_from(size)
        if room < 0:
            row, room, n = n, capacity, n + 1
        else:
            row = open_rows[room].pop()
            change(room, -1)
        rows[i] = row
        open_rows[room - size].append(row)
        change(room - size, 1)
    return rows, n


def tokenised(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, n, ids): each text's ids as compressed 32-bit numbers, by the tokenizer library. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        code = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n, out = [], []
            for t in batch.column(1).to_pylist():
                ids = np.array(code.encode_ordinary(t or ""), np.int32)
                n.append(len(ids))
                out.append(packed(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc", "n", "ids"])

    return docs.select(F.col(doc).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc long, n long, ids binary")


def pack(tokens: DataFrame, row: int = ROW, pad: int = PAD, bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """(bin, row, ids, cu_seqlens, positions, doc_ids, pieces, n_tokens): a matrix row each, from (doc, n, ids).

    ids: `row` numbers of 32 bits, least byte first, padded at the end; cu_seqlens: 0 and the end of each segment;
    positions: like ids, from 0 again in each segment, 0 in the padding; doc_ids and pieces: the document of each segment
    and which of its pieces it is. Documents without ids take no place; a null id is carried; rows that repeat an id
    are packed one by one, in the order of their ids' bytes. Rows are dealt to bins by their place in the table too, so that
    any number of rows of one id and length is spread; the same files give the same output. The number of bins follows
    the number of tokens. Empty table: empty result.
    """
    tokens = same_on_every_reading(tokens)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-int(total) // bin_tokens))
    dealt = tokens.where("n > 0").withColumn("bin", F.pmod(F.xxhash64("doc", "n", F.monotonically_increasing_id()), F.lit(bins)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        docs = t.column("doc").to_pylist()
        blobs = t.column("ids")
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is None, docs[i] or 0, blobs[i].as_py()))
        pieces, owner, number = [], [], []
        for i in order:
            ids = unpacked(blobs[i].as_py(), np.int32)[0]
            for k in range(0, len(ids), row):
                pieces.append(ids[k : k + row])
                owner.append(docs[i])
                number.append(k // row)
        lengths = np.array([len(p) for p in pieces], np.int64)
        at, n = best_fit_decreasing(lengths, row)
        held: list[list[int]] = [[] for _ in range(n)]
        for i, r in enumerate(at.tolist()):
            held[r].append(i)
        matrix, positions = np.full((n, row), pad, "<i4"), np.zeros((n, row), "<i4")
        ends = []
        for r, own in enumerate(held):
            edge = [0]
            for i in own:
                size = int(lengths[i])
                matrix[r, edge[-1] : edge[-1] + size] = pieces[i]
                positions[r, edge[-1] : edge[-1] + size] = np.arange(size)
                edge.append(edge[-1] + size)
            ends.append(edge)
        fixed = lambda m: pa.Array.from_buffers(
            pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * row * 4, row * 4, dtype=np.int32)), pa.py_buffer(m)])
        return pa.table([
            pa.array([t.column("bin")[0].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), fixed(matrix),
            pa.array(ends, pa.list_(pa.int32())), fixed(positions), pa.array([[owner[i] for i in own] for own in held], pa.list_(pa.int64())),
            pa.array([[number[i] for i in own] for own in held], pa.list_(pa.int32())), pa.array([e[-1] for e in ends], pa.int64()),
        ], names=["bin", "row", "ids", "cu_seqlens", "positions", "doc_ids", "pieces", "n_tokens"])

    return dealt.groupBy("bin").applyInArrow(run, SCHEMA)


SCHEMA = "bin int, row int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, pieces array<int>, n_tokens long"


def write_packed(tokens: DataFrame, path: str, row: int = ROW, pad: int = PAD, bin_tokens: int = BIN_TOKENS) -> None:
    """Write the packed matrix as Parquet."""
    pack(tokens, row, pad, bin_tokens).write.option("compression", "zstd").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def as_arrays(packed: DataFrame) -> DataFrame:
    """Rows of the matrix with ids and positions as array<int>; buffers are taken over as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if name in ("ids", "positions"):
                    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4")
                    ends = np.cumsum([0, *(len(x.as_py()) // 4 for x in column)])
                    column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return packed.mapInArrow(run, SCHEMA.replace("ids binary", "ids array<int>").replace("positions binary", "positions array<int>"))
