"""Written tables: what cuts a plan's lineage in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder where that is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="tidemark-")).rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone by now; the folder is temporary then
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again; it is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
