"""An extension: the mean spectrum of frames as they arrive. Not a capability of a batch
analysis, but the same aggregation over a watched folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "traj_id string, frame_idx long, k_idx int, k double, chi double"


def watched_points(spark: SparkSession, folder: str) -> DataFrame:
    """Spectra in long form from Parquet files that appear in a folder."""
    return spark.readStream.schema(POINTS).parquet(folder)


def running_mean(points: DataFrame) -> DataFrame:
    """Mean, population deviation and frames so far: constant state per grid point."""
    return points.groupBy("traj_id", "k_idx").agg(F.min("k").alias("k"), F.avg("chi").alias("chi"), F.stddev_pop("chi").alias("chi_std"), F.count("*").alias("nframes"))
