"""Solver inputs for absorber-centred clusters, by a registry of methods."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SpectrumConfig
from ..errors import StructureError
from ..operators import cards, structure

# Atomic numbers of common elements of these studies.
NUMBERS = {"H": 1, "C": 6, "N": 7, "O": 8, "Al": 13, "Si": 14, "S": 16, "Ti": 22, "Cr": 24, "Mn": 25, "Fe": 26, "Co": 27, "Ni": 28, "Cu": 29, "Zn": 30, "Pd": 46, "Ag": 47, "Ir": 77, "Pt": 78, "Au": 79}

#: A method gives the cards it writes for a configuration.
METHODS: dict[str, Callable[[SpectrumConfig], dict[str, str]]] = {
    "larixite": lambda c: {k: v for k, v in cards.DEFAULTS.items() if k != "SCF"},
    "pymatgen": lambda c: dict(cards.DEFAULTS),
}


def settings(config: SpectrumConfig) -> dict[str, str]:
    """The cards of the configured method; ``auto`` is the first that is registered. The
    user's own come on top, the radius always, a core hole never."""
    order = list(METHODS) if config.method == "auto" else [config.method]
    known = [m for m in order if m in METHODS]
    if not known:
        raise StructureError(f"no method {config.method}")
    merged = METHODS[known[0]](config) | config.user_tag_settings | {"RPATH": f"{config.radius:g}"}
    return {k: v for k, v in merged.items() if k != "COREHOLE"}


def solver_inputs(atoms: DataFrame, absorber: str, config: SpectrumConfig, by: Sequence[str]) -> DataFrame:
    """(by, text): the input around each structure's first atom of the absorbing element,
    or around the site with that number."""
    site = F.col("atom_id") == int(absorber) if absorber.isdigit() else F.col("symbol") == absorber.strip().capitalize()
    first = atoms.filter(site).groupBy(*by).agg(F.min("atom_id").alias("atom_id"))
    centres = atoms.join(first, [*by, "atom_id"], "left_semi")
    near = structure.neighbours(centres, atoms, config.radius, by)
    origin = centres.select(*by, *(F.col(c).alias(f"o{c}") for c in structure.XYZ))
    cluster = near.join(atoms, [*by, "atom_id"]).join(origin, list(by))
    z: Column = F.create_map(*(F.lit(v) for kv in NUMBERS.items() for v in kv))
    others = cluster.filter("dist > 0").groupBy(*by).agg(F.array_sort(F.collect_set("symbol")).alias("kinds"))
    placed = cluster.join(others, list(by), "left").select(*by, "atom_id", "symbol", F.coalesce(F.try_element_at(z, F.col("symbol")), F.lit(0)).alias("z"), (F.col("x") - F.col("ox")).alias("x"), (F.col("y") - F.col("oy")).alias("y"), (F.col("z") - F.col("oz")).alias("z_"), "dist", F.when(F.col("dist") == 0, 0).otherwise(F.array_position("kinds", F.col("symbol"))).cast("int").alias("ipot"))
    return cards.feff_input(placed, by, config.edge, settings(config))
