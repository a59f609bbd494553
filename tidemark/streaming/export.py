"""Export that survives restarts: every batch's rows stand once, whatever a stopped run left behind.

A batch is written to a folder of its own, then marked as committed by a file that is made in one step. A batch that
comes again after its mark is left alone; one that was stopped before it is written anew. Readers see marked batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The marked batches in order; none if the folder is missing."""
    fs, p = _at(spark, f"{folder}/commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def mark(spark: SparkSession, folder: str, batch: int) -> None:
    fs, p = _at(spark, f"{folder}/commits/{batch}")
    fs.mkdirs(p.getParent())
    fs.createNewFile(p)


def export_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """Write a batch of the one query that exports to folder; use it in foreachBatch, with a checkpoint kept over restarts."""
    spark = rows.sparkSession
    fs, p = _at(spark, f"{folder}/commits/{batch}")
    if not fs.exists(p):
        rows.write.mode("overwrite").parquet(f"{folder}/data/{batch}")
        mark(spark, folder, batch)


def exported(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows of committed batches; before the first of them an empty table."""
    paths = [f"{folder}/data/{n}" for n in committed(spark, folder)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
