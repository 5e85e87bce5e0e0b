"""Alignment, averaging and Fourier transform of spectra in long form:
(traj_id, frame_idx, k_idx, k, chi)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KSTEP, NFFT, SpectrumConfig
from ..functions import numeric as N

FT = "m int, r double, chir_re double, chir_im double, chir_mag double, chir_pha double"


def interpolate(knots: DataFrame, grid: DataFrame, by: Sequence[str], x: str = "x", y: str | Sequence[str] = "y") -> DataFrame:
    """(by, x, y...) at every grid point: linear between knots, 0 outside them; knots of
    equal x count as their mean. Two sorts of each series, one a direction, and no join of
    knots with points; the work grows with the knots and points, whatever their order."""
    ys = [y] if isinstance(y, str) else list(y)
    mean = knots.groupBy(*by, x).agg(*(F.avg(c).alias(c) for c in ys))
    knot = F.struct(F.col(x).alias("_x"), *(F.col(c) for c in ys))
    both = mean.select(*by, x, knot.alias("_k")).withColumn("_g", F.lit(False)).unionByName(grid.select(*by, x).withColumn("_g", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by)
    seen = lambda order: F.last("_k", ignorenulls=True).over(w.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_a", seen(F.asc(x))).withColumn("_b", seen(F.desc(x))).filter("_g")
    return out.select(*by, x, *(N.lerp(F.col(x), F.col("_a._x"), F.col(f"_a.{c}"), F.col("_b._x"), F.col(f"_b.{c}")).alias(c) for c in ys))


def reference_grid(spectra: DataFrame) -> DataFrame:
    """(traj_id, k_ref): the grid of each trajectory's first frame, for spectra with
    array columns k and chi."""
    return spectra.groupBy("traj_id").agg(F.min_by("k", "frame_idx").alias("k_ref"))


def aligned(spectra: DataFrame) -> DataFrame:
    """Long form of array spectra on their trajectory's reference grid. Frames that are
    on it already are only unfolded; the others are interpolated."""
    ref = spectra.join(reference_grid(spectra), "traj_id")
    unfold = lambda df, a, b: df.select("traj_id", "frame_idx", F.posexplode(F.arrays_zip(F.col(a).alias("k"), F.col(b).alias("chi"))).alias("k_idx", "p")).select("traj_id", "frame_idx", "k_idx", "p.k", "p.chi")
    equal = unfold(ref.filter(F.col("k") == F.col("k_ref")), "k", "chi")
    other = ref.filter(F.col("k") != F.col("k_ref"))
    by = ["traj_id", "frame_idx"]
    grid = other.select(*by, F.posexplode("k_ref").alias("k_idx", "k"))
    moved = interpolate(unfold(other, "k", "chi").drop("k_idx"), grid, by, "k", "chi")
    return equal.unionByName(grid.join(moved, [*by, "k"]).select(*by, "k_idx", "k", "chi"))


def average(df: DataFrame) -> DataFrame:
    """(traj_id, k_idx, k, chi, chi_std, nframes): mean and population deviation."""
    return df.groupBy("traj_id", "k_idx").agg(F.min("k").alias("k"), F.avg("chi").alias("chi"), F.stddev_pop("chi").alias("chi_std"), F.count("*").alias("nframes"))


def envelope(avg: DataFrame, weight: int) -> DataFrame:
    """Weighted mean, deviation and its band."""
    chi, std = N.k_weighted(F.col("chi"), F.col("k"), weight), N.k_weighted(F.col("chi_std"), F.col("k"), weight)
    return avg.select("traj_id", "k_idx", "k", chi.alias("chi_w"), std.alias("std_w"), (chi - std).alias("low"), (chi + std).alias("high"))


def first_step(points: DataFrame) -> float | None:
    """The distance of a grid's first two points, the least over the series."""
    at = lambda i: F.min(F.when(F.col("k_idx") == i, F.col("k")))
    return points.groupBy("traj_id").agg((at(1) - at(0)).alias("step")).filter("step > 0").agg(F.min("step")).collect()[0][0]


def on_grid(points: DataFrame, kstep: float, by: Sequence[str] = ("traj_id",)) -> tuple[DataFrame, int]:
    """(by, k_idx, k, chi) on the transform's grid k = k_idx * kstep, and its number of
    points: as they are where they lie on it, and else interpolated from 0 to the last
    point, 0 below the first."""
    off, last = points.agg(F.max(F.abs(F.col("k") - F.col("k_idx") * F.lit(kstep))), F.max("k")).collect()[0]
    n = int(math.floor((last or 0.0) / kstep + 1e-6)) + 1
    if off is None or off <= 1e-9 * max(1.0, last):
        return points.select(*by, "k_idx", "k", "chi"), n
    ends = points.groupBy(*by).agg(F.floor(F.max("k") / F.lit(kstep) + 1e-6).cast("int").alias("_n"))
    grid = ends.select(*by, F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("k_idx")).withColumn("k", F.col("k_idx") * F.lit(kstep))
    moved = interpolate(points, grid, by, "k", "chi")
    return moved.select(*by, F.round(F.col("k") / F.lit(kstep)).cast("int").alias("k_idx"), "k", "chi"), n


def n_radii(config: SpectrumConfig) -> int:
    step = math.pi / ((config.kstep or KSTEP) * (config.nfft or NFFT))
    return min((config.nfft or NFFT) // 2, int(math.floor(config.rmax_out / step + 1e-9)) + 1)


def fourier(df: DataFrame, config: SpectrumConfig, n_points: int, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """The windowed transform of spectra on the grid k = k_idx * kstep, as one equi-join
    with a basis of n_points * n_radii rows and one aggregation. Average first:
    the transform is linear, and magnitudes must never be averaged."""
    kstep, nfft, nr = config.kstep or KSTEP, config.nfft or NFFT, n_radii(config)
    spark = df.sparkSession
    turn = (F.col("k_idx") * F.col("m")) % nfft * F.lit(2 * math.pi / nfft)
    basis = spark.range(n_points).select(F.col("id").alias("k_idx")).select("k_idx", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("m")).select(F.col("k_idx").cast("int"), "m", F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    if n_points * nr <= 2_000_000:
        basis = F.broadcast(basis)
    w = N.ft_window(F.col("k"), config.window, config.kmin, config.kmax, config.dk, config.dk2)
    x = df.select(*by, F.col("k_idx").cast("int"), (N.k_weighted(F.col("chi"), F.col("k"), config.kweight) * w).alias("x"))
    scale = F.lit(kstep / math.sqrt(math.pi))
    sums = x.filter("x != 0").join(basis, "k_idx").groupBy(*by, "m").agg((F.sum(F.col("x") * F.col("c")) * scale).alias("chir_re"), (-F.sum(F.col("x") * F.col("s")) * scale).alias("chir_im"))
    re, im = F.col("chir_re"), F.col("chir_im")
    return sums.select(*by, "m", (F.col("m") * F.lit(math.pi / (kstep * nfft))).alias("r"), "chir_re", "chir_im", N.magnitude(re, im).alias("chir_mag"), N.phase(re, im).alias("chir_pha"))


def window_values(k: np.ndarray, config: SpectrumConfig) -> np.ndarray:
    """The numpy counterpart of ``ft_window``."""
    dk2 = config.dk if config.dk2 is None else config.dk2
    if config.window == "gaussian":
        return np.exp(-((k - (config.kmin + config.kmax) / 2) ** 2) / (2 * config.dk**2))
    if config.window == "kaiser":
        u = 1 - ((k - (config.kmin + config.kmax) / 2) / ((config.kmax - config.kmin) / 2)) ** 2
        return np.where(u >= 0, (np.i0(config.dk * np.sqrt(np.maximum(u, 0))) - 1) / (np.i0(config.dk) - 1), 0.0)
    shape = {"hanning": lambda t: np.sin(t * np.pi / 2) ** 2, "parzen": lambda t: t, "welch": lambda t: 1 - (1 - t) ** 2, "sine": lambda t: np.sin(t * np.pi / 2)}[config.window]
    rise = np.clip((k - (config.kmin - config.dk / 2)) / config.dk, 0, 1)
    fall = np.clip((config.kmax + dk2 / 2 - k) / dk2, 0, 1)
    return shape(rise) * shape(fall)


def fourier_frames(df: DataFrame, config: SpectrumConfig) -> DataFrame:
    """The transform of every row (traj_id, frame_idx, chi array on the grid i * kstep)
    by an FFT of each batch: without the points-times-radii rows of the join."""
    kstep, nfft, nr = config.kstep or KSTEP, config.nfft or NFFT, n_radii(config)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):
                g = f.iloc[at : at + 512]
                n = max((len(c) for c in g["chi"]), default=0)
                x = np.zeros((len(g), n))
                for i, c in enumerate(g["chi"]):
                    x[i, : len(c)] = c
                k = np.arange(n) * kstep
                x = x * k**config.kweight * window_values(k, config)
                x = np.pad(x, ((0, 0), (0, -n % nfft))).reshape(len(g), -1, nfft).sum(1)  # phases repeat after nfft points
                z = np.fft.fft(x)[:, :nr] * kstep / math.sqrt(math.pi)
                m = np.tile(np.arange(nr), len(g))
                yield pd.DataFrame({"traj_id": np.repeat(g["traj_id"].to_numpy(), nr), "frame_idx": np.repeat(g["frame_idx"].to_numpy(), nr), "m": m, "r": m * math.pi / (kstep * nfft), "chir_re": z.real.ravel(), "chir_im": z.imag.ravel(), "chir_mag": np.abs(z).ravel(), "chir_pha": np.angle(z).ravel()})

    kind = df.schema["traj_id"].dataType.simpleString()
    return df.select("traj_id", "frame_idx", "chi").mapInPandas(run, f"traj_id {kind}, frame_idx long, {FT}")


def path_sum(rows: DataFrame, paths: DataFrame, k: Sequence[float], s02: float = 1.0) -> DataFrame:
    """chi(k) of a set of scattering paths by the published EXAFS equation; the paths'
    tables are interpolated to the grid first, and k = 0 gives 0."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i, float(x)) for i, x in enumerate(k)], "k_idx int, x double")
    by = ["dir", "path_id"]
    columns = ["real2phc", "mag", "phase", "red", "lambda"]
    points = paths.select(*by).distinct().join(F.broadcast(grid))  # the caller's points, one row each
    at = interpolate(rows.withColumnRenamed("k", "x"), points, by, "x", columns)
    out = points.join(at, [*by, "x"]).join(paths.select(*by, "deg", "reff"), by)
    x, r = F.col("x"), F.col("reff")
    term = F.lit(s02) * F.col("deg") * F.col("mag") * F.col("red") / (x * r * r) * F.exp(-2 * r / F.col("lambda")) * F.sin(2 * x * r + F.col("real2phc") + F.col("phase"))
    return out.groupBy("dir", "k_idx").agg(F.min("x").alias("k"), F.sum(F.when(x > 0, term).otherwise(0.0)).alias("chi"))
