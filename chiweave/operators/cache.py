"""Reuse of computed spectra, keyed by everything they depend on, in Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import hit_rate
from ..sources.files import stored


def split(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """What the cache has, with its values, and what it misses. A key stored twice
    counts once."""
    one = cache.dropDuplicates([key])
    return wanted.join(one, key), wanted.join(cache.select(key), key, "left_anti")


def counters(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """(hits, misses, hit_rate)."""
    seen = wanted.join(cache.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    both = seen.agg(F.count("_hit").alias("hits"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("misses"))
    return both.withColumn("hit_rate", hit_rate(F.col("hits"), F.col("misses")))


class ResultCache:
    """A folder of Parquet files (cache_key, k, chi). ``path`` None: nothing is kept."""

    SCHEMA = "cache_key string, k array<double>, chi array<double>"

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self) -> bool:
        if not self.path:
            return False
        fs, at = self._fs()
        return fs.exists(at)

    def read(self) -> DataFrame:
        """All entries; unreadable files are passed over, as misses."""
        if not self.exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("ignoreCorruptFiles", "true").parquet(self.path)

    def store(self, rows: DataFrame) -> None:
        if self.path:
            rows.select("cache_key", "k", "chi").dropDuplicates(["cache_key"]).write.mode("append").parquet(self.path)

    def through(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
        """Cached rows, and the others computed (cache_key, ..., k, chi, error) and stored.
        What is computed is written once and read back, so no later step, and no lost
        executor, makes the solver run again."""
        if not self.path:
            return stored(compute(wanted))
        hits, misses = split(wanted, self.read())
        fresh = stored(compute(wanted if force else misses), f"{self.path}/_runs")  # the cache's reader passes over it
        self.store(fresh.filter("error IS NULL"))
        return fresh if force else hits.withColumn("error", F.lit(None).cast("string")).select(*fresh.columns).unionByName(fresh)

    def info(self) -> dict:
        """Files and their size."""
        if not self.exists():
            return {"enabled": bool(self.path), "files": 0, "bytes": 0, "size_mb": 0.0}
        fs, at = self._fs()
        found = [x for x in fs.listStatus(at) if x.getPath().getName().endswith(".parquet")]
        total = sum(x.getLen() for x in found)
        return {"enabled": True, "files": len(found), "bytes": total, "size_mb": round(total / 2**20, 2)}

    def clear(self) -> None:
        if self.exists():
            fs, at = self._fs()
            fs.delete(at, True)
