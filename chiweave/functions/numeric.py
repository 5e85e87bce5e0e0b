"""Column expressions for spectra and vectors; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def k_weighted(chi: Column, k: Column, weight: int) -> Column:
    return chi * F.pow(k, F.lit(float(weight))) if weight else chi


def bessel_i0(x: Column, terms: int = 31) -> Column:
    """The modified Bessel function of order 0, by its series."""
    q = x * x / 4.0
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(a: Column, i: Column) -> Column:
        t = a["term"] * q / (i * i).cast("double")
        return F.struct((a["sum"] + t).alias("sum"), t.alias("term"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, add, lambda a: a["sum"])


def ft_window(k: Column, shape: str, kmin: float, kmax: float, dk: float, dk2: float | None = None) -> Column:
    """A transform window: 1 on the plateau, tapers of width dk and dk2 centred on
    kmin and kmax. Rise and fall by shape: hanning sin^2, parzen linear, welch
    1 - (1 - t)^2, sine a quarter period. gaussian is a bell of width dk around the
    middle; kaiser is I0 of a half circle between kmin and kmax, minus its end value."""
    dk2 = dk if dk2 is None else dk2
    lit = lambda v: F.lit(float(v))
    if shape == "gaussian":
        mid = (kmin + kmax) / 2
        return F.exp(-((k - lit(mid)) * (k - lit(mid))) / lit(2.0 * dk * dk))
    if shape == "kaiser":
        half, mid = (kmax - kmin) / 2, (kmin + kmax) / 2
        u = 1.0 - F.pow((k - lit(mid)) / lit(half), lit(2.0))
        top = bessel_i0(lit(dk)) - 1.0
        return F.when(u >= 0.0, (bessel_i0(lit(dk) * F.sqrt(F.greatest(u, lit(0.0)))) - 1.0) / top).otherwise(lit(0.0))
    x1, x2, x3, x4 = kmin - dk / 2, kmin + dk / 2, kmax - dk2 / 2, kmax + dk2 / 2

    def taper(t: Column) -> Column:
        if shape == "hanning":
            return F.pow(F.sin(t * lit(math.pi / 2)), lit(2.0))
        if shape == "parzen":
            return t
        if shape == "welch":
            return 1.0 - (1.0 - t) * (1.0 - t)
        if shape == "sine":
            return F.sin(t * lit(math.pi / 2))
        raise ValueError(f"unknown window {shape}")

    rise, fall = (k - lit(x1)) / lit(x2 - x1), (lit(x4) - k) / lit(x4 - x3)
    return F.when((k < lit(x1)) | (k > lit(x4)), lit(0.0)).when(k < lit(x2), taper(rise)).when(k > lit(x3), taper(fall)).otherwise(lit(1.0))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The line through two knots at x; y0 where they coincide; 0 without both."""
    inside = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.when(x0.isNull() | x1.isNull(), F.lit(0.0)).otherwise(inside)


def same_grid(a: Column, b: Column) -> Column:
    return a == b


def compatible_grid(a: Column, b: Column, atol: float = 1e-12) -> Column:
    """Equal lengths and no point further apart than ``atol``."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= F.lit(atol))
    return (F.size(a) == F.size(b)) & near


def hit_rate(hits: Column, misses: Column) -> Column:
    """Per cent of hits; null where nothing was looked up."""
    return F.when(hits + misses > 0, hits / (hits + misses) * 100.0)
