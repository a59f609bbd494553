"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions given to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: A table of at most so many rows, and of so many bytes where rows can be wide, may be broadcast; each caller counts before it hints.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            found = tempfile.mkdtemp(prefix="tidemark-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table as compressed Parquet into the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table. It is written and read, for a checkpoint would carry the constraints that Catalyst
    knows of it into the next round's plan, where they multiply.
    """
    return stash(df, "cut")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone by now; the folder is temporary then
        return


def small(df: DataFrame, limit: int = BROADCAST_ROWS, width: Column | None = None) -> DataFrame:
    """The table with a broadcast hint if it holds at most `limit` rows, else as it is; df should be written or cut.

    width: bytes of a row, where that has no bound of its own; all rows together must then stay within BROADCAST_BYTES.
    """
    rows, size = df.agg(F.count("*"), F.lit(0) if width is None else F.sum(width)).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= BROADCAST_BYTES else df


#: A key with more than one in so many of all rows is hot; there are at most as many hot keys, whatever the table.
HOT_SHARE = 1000


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(docs: DataFrame) -> Column:
    """All columns in one struct with fields c0, c1, ..: nothing an operator adds can clash with them."""
    return F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def from_row(docs: DataFrame, row: str) -> list[Column]:
    """The columns of as_row(docs) again."""
    return [F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(docs.columns)]


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], count: str, spread: Column, total: int) -> DataFrame:
    """Inner join of many with one, which has a row per key and in `count` how many rows of many it meets; total: rows of many, or more.

    Hot keys are cut into parts of a thousandth of all rows: rows of many go to one by `spread`, and one's row is
    repeated for each. The HOT_SHARE keys of most rows hold all that are hot; their parts, one for those that aren't, are broadcast.
    """
    each = F.lit(max(64, -(-total // HOT_SHARE)))
    parts = F.when(F.col(count) > each, F.ceil(F.col(count) / each)).otherwise(1).cast("int")
    one = one.withColumn("__parts", parts)
    hot = F.broadcast(one.select(*keys, F.col("__parts").alias("__of"), count).orderBy(F.desc(count)).limit(HOT_SHARE).drop(count))
    many = many.join(hot, keys, "left").withColumn("__part", F.pmod(spread, F.coalesce("__of", F.lit(1)))).drop("__of")
    one = one.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts", count)
    return many.withColumn("__part", F.col("__part").cast("int")).join(one, [*keys, "__part"]).drop("__part")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
