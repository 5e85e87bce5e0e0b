"""Atoms in long form (structure, atom_id, symbol or type, x, y, z)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N

XYZ = ("x", "y", "z")


def centroid(atoms: DataFrame, by: Sequence[str]) -> DataFrame:
    return atoms.groupBy(*by).agg(*(F.avg(c).alias(f"c{c}") for c in XYZ))


def from_centre(atoms: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds dx, dy, dz and dist, relative to the structure's unweighted centre. The
    centres are aggregated and joined back, so a large structure is not one task."""
    both = atoms.join(centroid(atoms, by), list(by))
    both = both.withColumns({f"d{c}": F.col(c) - F.col(f"c{c}") for c in XYZ}).drop(*(f"c{c}" for c in XYZ))
    return both.withColumn("dist", N.norm3(F.col("dx"), F.col("dy"), F.col("dz")))


def composition(atoms: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, symbol, n, share): how many atoms of each species, and of all how much."""
    counts = atoms.groupBy(*by, "symbol").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def core_shell(dist: Column, cutoff: float) -> Column:
    """2 in the core (nearer than the cutoff), 1 in the shell."""
    return F.when(dist < F.lit(float(cutoff)), 2).otherwise(1)


def hemisphere(dx: Column, dy: Column, dz: Column, axis: Sequence[float]) -> Column:
    """1 on the axis's side of the centre, its plane included, 2 on the other."""
    length = sum(a * a for a in axis) ** 0.5
    if not length:
        raise ValueError("the axis has no direction")
    a, b, c = (float(v) / length for v in axis)
    return F.when(dx * F.lit(a) + dy * F.lit(b) + dz * F.lit(c) >= 0, 1).otherwise(2)


def species_of(type_id: Column, species: Sequence[str]) -> Column:
    """The species of a type counted from 1; null beyond the list."""
    return F.try_element_at(F.array(*(F.lit(s) for s in species)), type_id.cast("int"))


def absorber_ok(symbols: Column, absorber: str) -> Column:
    """Whether an absorber, a site number from 0 or an element, is in a structure."""
    if absorber.lstrip("-").isdigit():
        return (F.lit(int(absorber)) >= 0) & (F.lit(int(absorber)) < F.size(symbols))
    return F.array_contains(symbols, absorber.strip().capitalize())


def neighbours(centres: DataFrame, atoms: DataFrame, radius: float, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(by, centre_id, atom_id, dist): atoms within ``radius`` of each centre, itself
    included, with the columns ``keep`` of both (centre_NAME and NAME). Space is cut into
    cubes of that size; a centre meets only the 27 around it, so the join is on equal
    cubes, not on all pairs."""
    cube = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    near = centres.select(*by, F.col("atom_id").alias("centre_id"), *(F.col(c).alias(f"centre_{c}") for c in keep), *(F.col(c).alias(f"o{c}") for c in XYZ), *(cube(c).alias(f"g{c}") for c in XYZ))
    for c in XYZ:
        near = near.withColumn(f"g{c}", F.explode(F.sequence(F.col(f"g{c}") - 1, F.col(f"g{c}") + 1)))
    held = atoms.select(*by, "atom_id", *keep, *XYZ, *(cube(c).alias(f"g{c}") for c in XYZ))
    met = near.join(held, [*by, "gx", "gy", "gz"])
    dist = N.norm3(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("z") - F.col("oz"))
    return met.select(*by, "centre_id", "atom_id", *(f"centre_{c}" for c in keep), *keep, dist.alias("dist")).filter(F.col("dist") <= F.lit(float(radius)))


def radial_distribution(atoms: DataFrame, rmax: float, bins: int, by: Sequence[str]) -> DataFrame:
    """(by, type_a, type_b, bin, r, pairs, cn): ordered pairs by distance, and the
    running mean number of b within the bin's far edge around an a."""
    step = rmax / bins
    near = neighbours(atoms, atoms, rmax, by, ["type"]).filter("centre_id != atom_id").withColumn("bin", F.floor(F.col("dist") / F.lit(step)).cast("int")).filter(F.col("bin") < bins)
    counts = near.groupBy(*by, F.col("centre_type").alias("type_a"), F.col("type").alias("type_b"), "bin").agg(F.count("*").alias("pairs"))
    n = atoms.groupBy(*by, F.col("type").alias("type_a")).agg(F.count("*").alias("_n"))
    run = F.sum("pairs").over(Window.partitionBy(*by, "type_a", "type_b").orderBy("bin"))
    return counts.join(n, [*by, "type_a"]).select(*by, "type_a", "type_b", "bin", ((F.col("bin") + 0.5) * F.lit(step)).alias("r"), "pairs", (run / F.col("_n")).alias("cn"))


def mean_squared_displacement(atoms: DataFrame, by: Sequence[str], frame: str = "frame_idx") -> DataFrame:
    """(by, frame, type, msd): against each atom's place in the first frame, both taken
    relative to their frame's centre."""
    moved = from_centre(atoms, [*by, frame]).select(*by, frame, "atom_id", "type", "dx", "dy", "dz")
    first = moved.groupBy(*by).agg(F.min(frame).alias(frame))
    start = moved.join(first, [*by, frame], "left_semi").select(*by, "atom_id", *(F.col(f"d{c}").alias(f"s{c}") for c in XYZ))
    gone = sum(((F.col(f"d{c}") - F.col(f"s{c}")) * (F.col(f"d{c}") - F.col(f"s{c}")) for c in XYZ), F.lit(0.0))
    return moved.join(start, [*by, "atom_id"]).groupBy(*by, frame, "type").agg(F.avg(gone).alias("msd"))


# The basis of each cubic lattice, in cell edges.
BASIS = {"sc": [(0, 0, 0)], "bcc": [(0, 0, 0), (0.5, 0.5, 0.5)], "fcc": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]}


def lattice(spark: SparkSession, kind: str, constant: float, shells: int) -> DataFrame:
    """(x, y, z) of the sites in the cells -shells..shells around the origin."""
    if kind not in BASIS:
        raise ValueError("the lattice must be sc, bcc or fcc")
    cells = spark.range(1)
    for c in "ijk":
        cells = cells.withColumn(c, F.explode(F.sequence(F.lit(-shells), F.lit(shells))))
    sites = F.array(*(F.struct(*(F.lit(float(v)).alias(c) for c, v in zip("abc", b))) for b in BASIS[kind]))
    return cells.withColumn("b", F.explode(sites)).select(*(((F.col(i) + F.col(f"b.{a}")) * F.lit(float(constant))).alias(x) for i, a, x in zip("ijk", "abc", XYZ)))


def _atoms(sites: DataFrame, symbol: str) -> DataFrame:
    number = F.row_number().over(Window.orderBy(*XYZ)) - 1  # a cluster is small
    return sites.select(number.alias("atom_id"), F.lit(symbol).alias("symbol"), *XYZ)


def lattice_cluster(spark: SparkSession, kind: str, constant: float, shells: int, radius: float, symbol: str = "Au") -> DataFrame:
    """Atoms of an fcc, bcc or sc lattice within ``radius`` of the origin."""
    return _atoms(lattice(spark, kind, constant, shells).filter(N.norm3(*(F.col(x) for x in XYZ)) <= radius), symbol)


def plane_distance(kind: str, constant: float, plane: Sequence[int]) -> float:
    """The distance of neighbouring lattice planes (hkl); planes of mixed parity (fcc) or
    of odd sum (bcc) have one more between them."""
    h, k, l = (abs(int(v)) for v in plane)  # noqa: E741
    if not (h or k or l):
        raise ValueError("the plane has no direction")
    between = kind == "fcc" and len({h % 2, k % 2, l % 2}) > 1 or kind == "bcc" and (h + k + l) % 2 == 1
    return constant / math.sqrt(h * h + k * k + l * l) / (2 if between else 1)


def truncated_cluster(spark: SparkSession, kind: str, constant: float, surfaces: Sequence[Sequence[int]], layers: Sequence[int], symbol: str = "Au", vacuum: float | None = None, pbc: bool = False) -> tuple[DataFrame, list[float] | None]:
    """Atoms of a cluster around a lattice point that ends ``layers`` planes out along
    every surface of each family, and its cell's edges. With ``vacuum`` the atoms are
    centred in a box that leaves this much around them; a periodic cluster needs one."""
    if len(surfaces) != len(layers) or not surfaces:
        raise ValueError("give as many layers as surfaces")
    if pbc and vacuum is None:
        raise ValueError("a periodic cluster needs a vacuum")
    ends = {}
    for plane, n in zip(surfaces, layers):
        reach = n * plane_distance(kind, constant, plane)
        for p in set(permutations(plane)):
            for signs in product((1, -1), repeat=3):
                normal = tuple(int(a) * s for a, s in zip(p, signs))
                ends[normal] = min(reach, ends.get(normal, reach))
    # Planes along all cube axes or corners bound the cluster; a family always has both signs.
    far = max(r for r in ends.values())
    shells = math.ceil(far * 3 / constant) + 1
    inside = F.lit(True)
    for (h, k, l), reach in ends.items():  # noqa: E741
        inside = inside & ((F.col("x") * h + F.col("y") * k + F.col("z") * l) / F.lit(math.sqrt(h * h + k * k + l * l)) <= F.lit(reach + 1e-6))
    kept = lattice(spark, kind, constant, shells).filter(inside)
    if vacuum is None:
        return _atoms(kept, symbol), None
    box = kept.agg(*(f(x).alias(f"{n}{x}") for x in XYZ for f, n in ((F.min, "a"), (F.max, "z")))).collect()[0]
    cell = [box[f"z{x}"] - box[f"a{x}"] + 2 * vacuum for x in XYZ]
    return _atoms(kept.select(*((F.col(x) - F.lit(box[f"a{x}"]) + F.lit(float(vacuum))).alias(x) for x in XYZ)), symbol), cell
