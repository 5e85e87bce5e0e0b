"""Queries by name, each with the SQL that DuckDB runs to the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Spectra of the embeddings: a vector is chi(k) of a frame, its label the trajectory.
SPECTRA = "spectra AS (SELECT label AS traj_id, vec_id AS frame_idx, i AS k_idx, CAST(i AS DOUBLE) * 0.05e0 AS k, CAST(embedding[i + 1] AS DOUBLE) AS chi FROM embeddings, (SELECT CAST(unnest(range(64)) AS INTEGER) AS i))"
#: Their mean and spread over the frames of a trajectory.
MEAN = f"WITH {SPECTRA}, mean AS (SELECT traj_id, k_idx, min(k) AS k, avg(chi) AS chi, stddev_pop(chi) AS chi_std, count(*) AS nframes FROM spectra GROUP BY ALL)"
#: Atoms: the first three components of a vector are an atom of its label's structure.
ATOMS = "atoms AS (SELECT label AS s, vec_id AS atom_id, CAST(vec_id % 2 + 1 AS INTEGER) AS type, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


class Tables:
    """The tables of a folder, and what stands for spectra and atoms in them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spectra(self) -> DataFrame:
        at = F.posexplode("embedding").alias("k_idx", "e")
        return self.embeddings.select(F.col("label").alias("traj_id"), F.col("vec_id").alias("frame_idx"), at).select("traj_id", "frame_idx", "k_idx", (F.col("k_idx").cast("double") * F.lit(0.05)).alias("k"), F.col("e").cast("double").alias("chi"))

    def arrays(self) -> DataFrame:
        k = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("double") * F.lit(0.05))
        return self.embeddings.select(F.col("label").alias("traj_id"), F.col("vec_id").alias("frame_idx"), k.alias("k"), F.col("embedding").cast("array<double>").alias("chi"))

    def atoms(self) -> DataFrame:
        e = lambda i: F.get("embedding", F.lit(i)).cast("double")
        return self.embeddings.select(F.col("label").alias("s"), F.col("vec_id").alias("atom_id"), (F.col("vec_id") % 2 + 1).cast("int").alias("type"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"))

    def text(self, df: DataFrame, file: str, line_no: str, line: Column) -> DataFrame:
        return df.select(F.expr(file).cast("string").alias("file"), F.expr(line_no).alias("line_no"), line.alias("line"))


def r6(c: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
