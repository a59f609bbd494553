"""Blocks: runs of a partition's rows with a bounded amount of text, which meet dictionaries of their own content.

No dictionary then grows with the corpus, and a block's text travels compressed.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def same_on_every_reading(docs: DataFrame) -> DataFrame:
    """docs, written to the shared folder first if its plan shuffles or samples, so that each reading has the same blocks."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return stash(docs, "blocks") if re.search(r"Exchange|QueryStage|Sample|Python|Arrow", plan) else docs


def parts_for(docs: DataFrame, text: str, each: int) -> int:
    """How many parts of about `each` bytes of text there are; never fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // each))


def blocks_of(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[tuple[int, pa.Table]]:
    """(block, rows): the partition's rows, cut whenever their texts (a column's place) reach `limit` bytes."""
    n, held, size = 0, [], 0
    first = TaskContext.get().partitionId() << 20
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = base = 0
        while at < len(ends):
            stop = min(len(ends), int(np.searchsorted(ends, base + limit - size)) + 1)
            held.append(batch.slice(at, stop - at))
            size, base, at = size + int(ends[stop - 1]) - base, int(ends[stop - 1]), stop
            if size >= limit:
                yield first + n, pa.Table.from_batches(held)
                n, held, size = n + 1, [], 0
    if held:
        yield first + n, pa.Table.from_batches(held)


def shipped(docs: DataFrame, limit: int, text: int = 0) -> DataFrame:
    """(block, rows): each block's rows in one compressed value."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks_of(batches, text, limit):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return docs.mapInArrow(ship, "block long, rows binary")


def received(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of blocks from shipped()."""
    for blob in table.column("rows"):
        yield pa.ipc.open_stream(blob.as_buffer()).read_all()


def give_back() -> None:
    """Return freed memory to the system: a worker is used again, beside others, and would keep what a large block took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; an increasing array of 64-bit numbers packs best as its differences."""
    import zstandard

    heads = np.array([len(arrays), *[x.nbytes for x in arrays]], np.int64).tobytes()
    return zstandard.compress(heads + b"".join(x.tobytes() for x in arrays), 3)


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """Numbers by significance of their bytes, which packs better."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.copy()


def numbers(x: np.ndarray, kind: type) -> np.ndarray:
    """The numbers of planes()."""
    return x.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()
