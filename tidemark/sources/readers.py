"""Sources and sinks: delimited sample files, archives, manifests, tables and generators."""

from __future__ import annotations

import atexit
import ctypes
import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite, number, stem_id
from ..operators.scratch import _remove, shared_folder

#: Columns of a sample file by position; the third and fourth are not used.
POSITIONS = {"t": 0, "cores": 1, "cpu_percent": 4, "capacity": 5, "used": 6, "disk_read": 7, "disk_write": 8, "net_in": 9, "net_out": 10}
FIELDS = 11


def read_samples(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Semicolon files below a folder, one entity per file: entity, file, seq and the columns by position.

    Rows with fewer columns have nulls; numbers that don't parse are null; files whose stem is no integer are skipped.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(FIELDS)])
    r = (
        spark.read.schema(schema).option("sep", ";").option("header", True).option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("mode", "PERMISSIVE").csv(path)
    )
    named = r.select(
        stem_id("_metadata.file_path").alias("entity"), F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("seq"), *[number(f"c{i}").alias(k) for k, i in POSITIONS.items()],
    )
    return named.where(F.col("entity").isNotNull())


def entity_files(samples: DataFrame) -> DataFrame:
    """(entity, files): files per entity, for the rule on month boundaries and for checks of the expected count."""
    return samples.select("entity", "file").distinct().groupBy("entity").agg(F.count("*").alias("files"))


def expect_entities(samples: DataFrame, n: int) -> DataFrame:
    """samples, or a failure of the query if they don't have n entities."""
    found = samples.select("entity").distinct().agg(F.count("*").alias("__n"))
    check = found.select(F.when(F.col("__n") != n, F.raise_error(F.concat(F.lit("entities: "), F.col("__n").cast("string"))).cast("int")).alias("__ok"))
    return samples.join(F.broadcast(check)).where(F.col("__ok").isNull()).drop("__ok")  # one row


def read_lines(lines: DataFrame) -> DataFrame:
    """(t, cores, cpu) of text lines cut at ';' and tabs; lines of fewer than five fields or without numbers go."""
    f = F.split("value", r";\t?")
    out = lines.select("*", f.alias("__f")).where(F.size("__f") >= 5)
    out = out.withColumns({"t": number(F.trim(F.col("__f")[0])), "cores": number(F.trim(F.col("__f")[1])), "cpu": number(F.trim(F.col("__f")[4]))})
    return out.where(finite("t") & finite("cores") & finite("cpu")).withColumn("payload", F.array_join(F.slice("__f", 2, 100), ";")).drop("__f")


def read_zip(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """(member, seq, value): lines of the members of zip files. An archive is one task's work; a member streams."""
    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        with z.open(name) as member:
                            held: list[str] = []
                            first = 0
                            for line in member:
                                held.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                                if len(held) == 50_000:
                                    yield pd.DataFrame({"member": name, "seq": range(first, first + len(held)), "value": held})
                                    first, held = first + len(held), []
                            yield pd.DataFrame({"member": name, "seq": range(first, first + len(held)), "value": held})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "member string, seq long, value string")


def read_external(spark: SparkSession, path: str, column: str, divisor: float) -> DataFrame:
    """A one-column series in file order: (i, x), numbers over a unit divisor, what is no number left out."""
    r = spark.read.option("header", True).csv(path).select(F.monotonically_increasing_id().alias("i"), number(column).alias("x"))
    return r.where(finite("x")).withColumn("x", F.col("x") / divisor)


def cached_table(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The Parquet table at path, built there first if it is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if force or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row result as a JSON file, its keys in order."""
    row = df.first()
    text = json.dumps(row.asDict(True) if row else {}, sort_keys=True, default=str)
    df.sparkSession.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


#: Files over so many bytes are read in splits and hashed slice by slice; no task has more of a file.
SLICE = 256 << 20
#: Names that Spark's text reader would decompress; such a file is read whole.
CODEC = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd)$"


def inventory(spark: SparkSession, path: str, glob: str = "*", slice_bytes: int = SLICE) -> DataFrame:
    """(path, length, sha256) of files below a folder; files over slice_bytes by sliced_sha256. Spark leaves out empty files."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    sliced = (F.col("length") > slice_bytes) & ~F.col("path").rlike(CODEC)
    large = [(x.path, x.length) for x in r.select("path", "length").where(sliced).collect()]
    # By its length a file is left out before it is read; by its name only after.
    out = r.where(F.col("length") <= slice_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    whole = [x.path for x in r.select("path", "length").where((F.col("length") > slice_bytes) & F.col("path").rlike(CODEC)).collect()]
    if whole:
        out = out.unionByName(spark.read.format("binaryFile").load(whole).select("path", "length", F.sha2("content", 256).alias("sha256")))
    return out.unionByName(sliced_sha256(spark, large, slice_bytes)) if large else out


def sliced_sha256(spark: SparkSession, files: list[tuple[str, int]], slice_bytes: int) -> DataFrame:
    """(path, length, sha256) of large files (path, length).

    SHA-256 is one chain over a file's bytes, so slices follow one another: a round hashes every file's next slice from the
    state that the last one left (112 bytes a file, by OpenSSL's structure, for hashlib gives none out). Spark's binary
    files come whole and end at 2 GB; its text reader splits files, and its lines, with their ends put back, are all
    bytes. They are written once, by slice. A line is one value: a run of 2 GB without a line feed fails. A file whose
    bytes don't add up to its length fails the query.
    """
    piece = min(8 << 20, slice_bytes)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the splits' bytes: file, start of the split, number within it, slice, data."""
        at, n, done, held = None, 0, 0, bytearray()

        def out() -> pa.RecordBatch:
            row = [[at[0]], [at[1]], [n], [(at[1] + done) // slice_bytes], [bytes(held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names)

        kinds, names = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["file", "start", "n", "slice", "data"]
        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (file, start) or len(held) >= piece:
                    if held:
                        yield out()
                    n, done = (n + 1, done + len(held)) if at == (file, start) else (0, 0)
                    at, held = (file, start), bytearray()
                held += line
                held += b"\n"
        if held:
            yield out()

    parts = None
    for i, (path, _) in enumerate(files):
        lines = spark.read.option("lineSep", "\n").text(path).select(F.lit(i).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
        parts = lines if parts is None else parts.unionByName(lines)
    folder = f"{shared_folder(spark)}/tidemark-slices-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    schema = "file int, start long, n int, slice int, data binary"
    parts.mapInArrow(joined, schema).write.option("compression", "none").partitionBy("slice").parquet(folder)
    pieces = spark.read.schema(schema).parquet(folder)
    found = {r.file: r.size for r in pieces.groupBy("file").agg(F.sum(F.octet_length("data").cast("long")).alias("size")).collect()}
    left = {}
    for i, (path, length) in enumerate(files):
        # Each line got an end, the last one too; the reader leaves out a byte order mark.
        mark = b"\xef\xbb\xbf" if found.get(i, 0) - length in (-3, -2) else b""
        if found.get(i, 0) + len(mark) - length not in (0, 1):
            raise ValueError(f"{path}: read {found.get(i, 0)} of {length} bytes")
        left[i] = (None, length, mark)

    def hashed(left: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import _hashlib

            lib = ctypes.CDLL(_hashlib.__file__)  # what it is linked with has the functions
            states: dict = {}

            def feed(own: list, data: bytes) -> None:
                lib.SHA256_Update(own[0], data, ctypes.c_size_t(min(len(data), own[1])))
                own[1] -= min(len(data), own[1])

            for batch in batches:
                for file, data in zip(batch.column("file").to_pylist(), batch.column("data"), strict=True):
                    if file not in states:
                        state, length, mark = left[file]
                        states[file] = [ctypes.create_string_buffer(state or b"", 256), length]
                        if state is None:
                            lib.SHA256_Init(states[file][0])
                            feed(states[file], mark)
                    feed(states[file], data.as_py())
            for own in states.values():
                own.append(None)
                if own[1] == 0:
                    end = ctypes.create_string_buffer(32)
                    lib.SHA256_Final(end, ctypes.create_string_buffer(own[0].raw, 256))
                    own[2] = end.raw.hex()
            rows = [[*states], [bytes(own[0].raw[:112]) for own in states.values()], [own[1] for own in states.values()], [own[2] for own in states.values()]]
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], ["file", "state", "rest", "sha256"])

        return run

    digests: dict[int, str] = {}
    for k in range(max(length for _, length in files) // slice_bytes + 1):
        own = pieces.where(F.col("slice") == k).select("file", "start", "n", "data").repartition("file").sortWithinPartitions("file", "start", "n")
        for r in own.mapInArrow(hashed(left), "file int, state binary, rest long, sha256 string").collect():
            left[r.file] = (bytes(r.state), r.rest, b"")
            digests[r.file] = r.sha256
    if any(digests.get(i) is None for i in range(len(files))):
        raise ValueError("a file's slices don't end with its last byte")
    return spark.createDataFrame([(path, length, digests[i]) for i, (path, length) in enumerate(files)], "path string, length long, sha256 string")


def verify_sha256(spark: SparkSession, path: str, expected: str) -> None:
    found = [r.sha256 for r in inventory(spark, path).limit(2).collect()]
    if found != [expected]:
        raise ValueError(f"SHA-256 of {path} is {found}, expected {expected}")


def beta_windows(spark: SparkSession, windows: int, samples: int = 12, seed: int = 7, block: int = 10_000) -> DataFrame:
    """(window_id, pos, x): Beta(2, 7) values, one in forty replaced by a burst of [0.9, 1]; seeded per block of windows."""
    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame["id"]:
                rng = np.random.default_rng([seed, int(b)])
                n = min(block, windows - int(b) * block)
                x = rng.beta(2, 7, (n, samples))
                x = np.where(rng.random(x.shape) < 0.025, rng.uniform(0.9, 1.0, x.shape), x)
                w = np.repeat(np.arange(n) + int(b) * block, samples)
                yield pd.DataFrame({"window_id": w, "pos": np.tile(np.arange(samples), n), "x": x.ravel()})

    return spark.range(-(-windows // block)).mapInPandas(make, "window_id long, pos long, x double")
