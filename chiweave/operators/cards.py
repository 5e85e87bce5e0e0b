"""Input cards as rows (file, line_no, line), and the merging of settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What a solver input sets unless told otherwise.
DEFAULTS = {"S02": "1.0", "EXCHANGE": "0", "CONTROL": "1 1 1 1 1 1", "PRINT": "1 0 0 0 0 3", "EXAFS": "20", "NLEG": "6", "SCF": "5.0"}


def merged(defaults: Column, given: Column, radius: Column, dropped: Sequence[str] = ("COREHOLE",)) -> Column:
    """Defaults, overlaid by the given settings, then RPATH; without the dropped tags."""
    kept = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(given), k))
    every = F.map_filter(F.map_concat(kept, given), lambda k, v: (k != "RPATH") & ~k.isin(*dropped))
    return F.map_concat(every, F.create_map(F.lit("RPATH"), radius))


def without_nulls(settings: Column) -> Column:
    return F.map_filter(settings, lambda k, v: v.isNotNull())


def rewritten(rows: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Lines whose first token is a set tag get its value; tags that no line has follow
    the first EDGE line, the last one given first. (file, line_no, sub, line)."""
    tag = T.token(F.col("line"), 0)
    line = F.col("line")
    for k, v in settings.items():
        line = F.when(tag == k, F.lit(f"{k:<10}{v}")).otherwise(line)
    done = rows.select("file", "line_no", F.lit(0).alias("sub"), line.alias("line"))
    if not settings:
        return done
    per = rows.groupBy("file").agg(F.min(F.when(tag == "EDGE", F.col("line_no"))).alias("line_no"), F.collect_set(F.when(tag.isin(*settings), tag)).alias("present"))
    order = list(reversed(settings))
    missing = per.filter("line_no IS NOT NULL").select("file", "line_no", F.explode(F.array_except(F.array(*(F.lit(k) for k in order)), "present")).alias("tag"))
    place = F.array_position(F.array(*(F.lit(k) for k in order)), F.col("tag")).cast("int")
    value = F.element_at(F.create_map(*(F.lit(x) for k, v in settings.items() for x in (k, f"{k:<10}{v}"))), F.col("tag"))
    return done.unionByName(missing.select("file", "line_no", place.alias("sub"), value.alias("line")))


def joined(rows: DataFrame) -> DataFrame:
    """(file, text): the lines of each file in order again."""
    w = F.array_sort(F.collect_list(F.struct("line_no", "sub", "line")))
    return rows.groupBy("file").agg(F.concat_ws("\n", F.transform(w, lambda x: x["line"])).alias("text"))


def feff_input(atoms: DataFrame, by: Sequence[str], edge: str, settings: dict[str, str]) -> DataFrame:
    """(by, text): a solver input for absorber-centred clusters (by, symbol, z, x, y, z_,
    ipot, dist); ipot 0 is the absorber."""
    cards = "\n".join([f"{'EDGE':<10}{edge}", *(f"{k:<10}{v}" for k, v in settings.items())])
    pots = atoms.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("ipot", "z", "symbol"))).alias("p"), F.array_sort(F.collect_list(F.struct("dist", "atom_id", "x", "y", "z_", "ipot", "symbol"))).alias("a"))
    pot = F.transform("p", lambda x: F.format_string("%6d%6d    %s", x["ipot"], x["z"], x["symbol"]))
    atom = F.transform("a", lambda x: F.format_string("%10.5f%10.5f%10.5f%4d  %-4s%10.5f", x["x"], x["y"], x["z_"], x["ipot"], x["symbol"], x["dist"]))
    return pots.select(*by, F.concat(F.lit(cards + "\n\nPOTENTIALS\n"), F.concat_ws("\n", pot), F.lit("\n\nATOMS\n"), F.concat_ws("\n", atom), F.lit("\nEND\n")).alias("text"))


def ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line_no", "sub")))
