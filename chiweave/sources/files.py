"""Files and folders through the file system that Spark itself uses for a path."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match, sorted."""
    system, at = _system(spark, pattern)
    return sorted(x.getPath().toString() for x in system.globStatus(at) or [])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as workers can open it."""
    system, at = _system(spark, path)
    full = system.makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, at = _system(spark, path)
    out = system.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def delete(spark: SparkSession, path: str) -> None:
    system, at = _system(spark, path)
    system.delete(at, True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``df`` once and reads it back, so that nothing computes it again, even if an
    executor is lost. The folder is ``folder``, or the one that ``spark.checkpoint.dir``
    names; a local temporary one only on a local master."""
    spark = df.sparkSession
    root = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chiweave-")
    at = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
