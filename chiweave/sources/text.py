"""Readers of the line-oriented formats. ``lines`` gives (file, line_no, line); each
parser takes such lines, so text from any table can be parsed as well."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ProcessingError
from ..functions import text as T


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of small files, numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def ordered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of files of any size: ``line_no`` is its block's place and its order in
    it, so lines sort as in the file though its blocks are read by different tasks."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("line_no"), F.col("value").alias("line"))


def data_lines(rows: DataFrame) -> DataFrame:
    """Without comments and blank lines."""
    return rows.filter((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))


def chi_dat(rows: DataFrame) -> DataFrame:
    """(file, k_idx, k, chi, mag, phase) of chi(k) files. Columns are taken in the order
    of a comment that names k and chi, and else by position."""
    names = F.filter(F.split(F.lower(F.regexp_replace("line", r"[#,]", " ")), r"\s+"), lambda t: t != "")
    heads = rows.filter(F.ltrim("line").startswith("#")).withColumn("names", names).filter(F.array_contains("names", "k") & F.array_contains("names", "chi"))
    head = heads.groupBy("file").agg(F.max_by("names", "line_no").alias("names"))
    values = data_lines(rows).withColumn("v", T.numbers(F.col("line"))).filter((F.size("v") >= 2) & F.get("v", F.lit(0)).isNotNull() & F.get("v", F.lit(1)).isNotNull())
    both = values.join(head, "file", "left").withColumn("names", F.coalesce("names", F.array(*(F.lit(c) for c in ("k", "chi", "mag", "phase")))))
    at = lambda c: F.get("v", F.array_position("names", F.lit(c)).cast("int") - 1).alias(c)
    number = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1
    return both.select("file", number.alias("k_idx"), at("k"), at("chi"), at("mag"), at("phase"))


def frame_spectra(spark: SparkSession, directory: str) -> DataFrame:
    """(traj_id, frame_idx, k, chi, error) of frame_*/chi.dat below a directory, frames
    numbered by their name's number. A file without a readable point has an error."""
    raw = lines(spark, f"{directory}/frame_*/chi.dat")
    index = F.regexp_extract("file", r"frame_(\d+)/chi\.dat$", 1).cast("long")
    points = chi_dat(raw).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k_idx", "k", "chi"))).alias("p"))
    files = raw.select("file").distinct().join(points, "file", "left")
    take = lambda c: F.transform("p", lambda x: x[c]).alias(c)
    return files.select(F.lit(directory.rstrip("/").rsplit("/", 1)[-1]).alias("traj_id"), index.alias("frame_idx"), take("k"), take("chi"), F.when(F.col("p").isNull(), F.lit("no readable point")).alias("error"))


def first_frame_types(rows: DataFrame) -> DataFrame:
    """(file, atom_id, type) of the first frame of a LAMMPS text dump given as lines,
    the columns found by the header's names."""
    head = rows.filter(F.col("line").startswith("ITEM: ATOMS")).groupBy("file").agg(F.min("line_no").alias("at"), F.min_by("line", "line_no").alias("head"))
    ends = rows.filter(F.col("line").startswith("ITEM:")).join(head.select("file", "at"), "file").filter("line_no > at").groupBy("file").agg(F.min("line_no").alias("end"))
    names = F.slice(T.tokens(F.col("head")), 3, 1000)
    place = lambda c: F.array_position(names, F.lit(c)).cast("int") - 1
    span = head.join(ends, "file", "left").select("file", "at", "end", place("id").alias("id_at"), place("type").alias("type_at"))
    body = rows.join(span, "file").filter((F.col("line_no") > F.col("at")) & (F.col("end").isNull() | (F.col("line_no") < F.col("end"))) & (F.trim("line") != ""))
    t = F.split(F.trim("line"), r"\s+")
    return body.select("file", F.get(t, F.col("id_at")).try_cast("long").alias("atom_id"), F.get(t, F.col("type_at")).try_cast("int").alias("type"))


def lammps_dump(spark: SparkSession, path: str) -> DataFrame:
    """(file, timestep, atom_id, type, xs, ys, zs, fx, fy, fz). The separator is the
    frame's first line, so a long trajectory splits over tasks, a frame a row."""
    raw = spark.read.option("lineSep", "ITEM: TIMESTEP\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    parts = raw.select("file", F.element_at(F.split("value", "\n"), 1).try_cast("long").alias("timestep"), F.split("value", r"ITEM: ATOMS ").alias("p")).filter(F.size("p") > 1)
    body = parts.select("file", "timestep", F.split(F.element_at("p", 2), "\n").alias("l"))
    rows = body.select("file", "timestep", T.tokens(F.element_at("l", 1)).alias("names"), F.explode(F.slice("l", 2, 1 << 30)).alias("line")).filter(F.trim("line") != "")
    at = lambda c: F.get(T.tokens(F.col("line")), F.array_position("names", F.lit(c)).cast("int") - 1)
    return rows.select("file", "timestep", at("id").try_cast("long").alias("atom_id"), at("type").try_cast("int").alias("type"), *(at(c).try_cast("double").alias(c) for c in ("xs", "ys", "zs", "fx", "fy", "fz")))


def pair_species(rows: DataFrame) -> DataFrame:
    """(file, species): the elements that the first ``pair_coeff * * file A B`` names."""
    found = rows.filter(F.ltrim("line").startswith("pair_coeff") & F.col("line").contains("*"))
    return found.groupBy("file").agg(F.slice(F.min_by(T.tokens(F.col("line")), F.col("line_no")), 5, 1000).alias("species"))


def run_info(rows: DataFrame) -> DataFrame:
    """(file, temp, timestep, nsteps, pair_style, species, averaging_time) of a LAMMPS
    deck; of several lines for one fact, the last counts."""
    t, n, s = T.tokens(F.col("line")), F.col("line_no"), F.ltrim("line")
    last = lambda ok, value: F.max_by(F.when(ok, value), F.when(ok, n))
    end = F.try_element_at(t, F.lit(-1))
    pair = s.startswith("pair_coeff") & s.contains(".json")
    info = rows.groupBy("file").agg(
        last(s.startswith("variable TEMP equal"), end).try_cast("double").alias("temp"),
        last(s.startswith("timestep"), end).try_cast("double").alias("timestep"),
        last(s.startswith("variable NUMMDSTEPS equal"), end).try_cast("long").alias("nsteps"),
        last(s.startswith("pair_style"), F.try_element_at(t, F.lit(2))).alias("pair_style"),
        last(pair, F.array(F.concat(F.try_element_at(t, F.lit(-2)), F.lit("1")), F.concat(end, F.lit("2")))).alias("species"),
    )
    return info.withColumn("averaging_time", F.col("nsteps") * F.col("timestep"))


def rdf(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(file, bin, r, g11, cn11, g12, cn12, g21, cn21, g22, cn22): lines of exactly ten
    numbers; others are skipped. ``strict`` raises where none is left."""
    kept = data_lines(rows).filter(F.col("line").rlike(T.numeric_line(10)))
    if strict and kept.isEmpty():
        raise ProcessingError("no line of ten numbers")
    t = F.split(F.trim("line"), r"\s+")
    names = ("r", "g11", "cn11", "g12", "cn12", "g21", "cn21", "g22", "cn22")
    return kept.select("file", F.get(t, F.lit(0)).cast("double").cast("int").alias("bin"), *(F.get(t, F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(names)))


def rdf_long(table: DataFrame, positive: bool = True) -> DataFrame:
    """(file, bin, r, series, g, cn), without g of 0 unless asked for."""
    pairs = ", ".join(f"'{p}', g{p}, cn{p}" for p in ("11", "12", "21", "22"))
    long = table.select("file", "bin", "r", F.expr(f"stack(4, {pairs}) AS (series, g, cn)"))
    return long.filter("g > 0") if positive else long


def msd(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(file, timestep, msd_all, msd_ag, msd_au, largest, species, drifting) from the
    last data line; drifting if any exceeds the threshold."""
    last = data_lines(rows).groupBy("file").agg(F.max_by("line", "line_no").alias("line")).withColumn("v", T.numbers(F.col("line")))
    names = ("all", "ag", "au")
    out = last.select("file", F.get("v", F.lit(0)).cast("long").alias("timestep"), *(F.get("v", F.lit(i + 1)).alias(f"msd_{c}") for i, c in enumerate(names)))
    best = F.array_max(F.array(*(F.struct(F.col(f"msd_{c}").alias("v"), F.lit(c).alias("s")) for c in names)))
    return out.withColumn("largest", best["v"]).withColumn("species", best["s"]).withColumn("drifting", best["v"] > F.lit(threshold))


def feff_paths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dir, path_id, nleg, deg, reff, rnrmav, edge) and (dir, path_id, k, real2phc, mag,
    phase, red, lambda, realp) of feffNNNN.dat files."""
    kept = rows.withColumn("dir", F.regexp_replace("file", r"/[^/]*$", "")).withColumn("path_id", F.regexp_extract("file", r"(?i)feff(\d+)\.dat$", 1).try_cast("int")).filter("path_id IS NOT NULL")
    head = kept.filter(F.col("line").contains("nleg, deg, reff")).withColumn("v", T.tokens(F.col("line")))
    at = lambda i, t, c: F.get("v", F.lit(i)).try_cast(t).alias(c)
    paths = head.select("dir", "path_id", at(0, "int", "nleg"), *(at(i + 1, "double", c) for i, c in enumerate(("deg", "reff", "rnrmav", "edge"))))
    start = kept.filter(F.col("line").contains("real[2*phc]")).select("dir", "path_id", F.col("line_no").alias("at"))
    body = kept.join(start, ["dir", "path_id"]).filter((F.col("line_no") > F.col("at")) & T.all_numeric(F.col("line"), 7)).withColumn("v", T.numbers(F.col("line")))
    names = ("k", "real2phc", "mag", "phase", "red", "lambda", "realp")
    return paths, body.select("dir", "path_id", *(F.get("v", F.lit(i)).alias(c) for i, c in enumerate(names)))


def feff_cards(rows: DataFrame) -> DataFrame:
    """(file, line_no, tag, value) of every line of a feff.inp that is no comment,
    whatever block it is in."""
    kept = rows.filter((F.trim("line") != "") & ~F.ltrim("line").startswith("*"))
    return kept.select("file", "line_no", T.token(F.col("line"), 0).alias("tag"), F.trim(F.regexp_replace(F.ltrim("line"), r"^\S+", "")).alias("value"))


def feff_atoms(rows: DataFrame) -> DataFrame:
    """(file, x, y, z, ipot, tag, distance) of the ATOMS block."""
    start = rows.filter(F.upper(F.trim("line")) == "ATOMS").groupBy("file").agg(F.min("line_no").alias("at"))
    t = T.tokens(F.col("line"))
    body = rows.join(start, "file").filter(F.col("line_no") > F.col("at")).withColumn("t", t)
    at = lambda i, kind, c: F.get("t", F.lit(i)).try_cast(kind).alias(c)
    out = body.select("file", at(0, "double", "x"), at(1, "double", "y"), at(2, "double", "z"), at(3, "int", "ipot"), at(4, "string", "tag"), at(5, "double", "distance"))
    return out.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND ipot IS NOT NULL")


_LATTICE = re.compile(r'Lattice\s*=\s*"([^"]*)"', re.I)
_PROPERTIES = re.compile(r"Properties\s*=\s*(\S+)", re.I)
_ATOM_LINES = "file string, frame_idx int, atom_id int, line string, symbol_at int, place_at int, cell array<double>"


def _comment(line: str) -> tuple[int, int, list[float] | None]:
    """Of a frame's comment: the columns of the symbol and of x, and the cell if it names one."""
    symbol_at, place_at, at = 0, 1, 0
    found = _PROPERTIES.search(line)
    parts = found.group(1).strip('"').split(":") if found else []
    for name, _, n in zip(parts[::3], parts[1::3], parts[2::3]):
        if name in ("species", "pos") and n.isdigit():
            symbol_at, place_at = (at, place_at) if name == "species" else (symbol_at, at)
        at += int(n) if n.isdigit() else 1
    cell = _LATTICE.search(line)
    try:
        values = [float(v) for v in cell.group(1).split()] if cell else []
    except ValueError:
        values = []
    return symbol_at, place_at, values if len(values) == 9 else None


def xyz(rows: DataFrame) -> DataFrame:
    """(file, frame_idx, atom_id, symbol, x, y, z, cell) of XYZ and extended XYZ files of
    one or more frames: a line with the number of atoms, a comment whatever it says, and
    that many atoms. ``cell`` has the nine numbers of a Lattice, or is null. A file ends
    where a count should stand and none does; blank lines between frames are passed over.

    Lines of a file are walked in order, without holding them; what they say is parsed
    afterwards, so only the walk is one task a file.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, frame, n, left, said = None, -1, 0, 0, (0, 1, None)
        comes = "count"
        for f in frames:
            out = []
            for file, line in zip(f["file"], f["line"]):
                if file != at:
                    at, frame, left, comes = file, -1, 0, "count"
                if left:
                    out.append((file, frame, n - left, line, *said))
                    left -= 1
                elif comes == "comment":
                    said, left, comes = _comment(line), n, "count"
                elif comes == "count" and line.strip():
                    if line.strip().isdecimal():
                        n, frame, comes = int(line), frame + 1, "comment"
                    else:
                        comes = "nothing"
            yield pd.DataFrame(out, columns=["file", "frame_idx", "atom_id", "line", "symbol_at", "place_at", "cell"])

    atoms = rows.select("file", "line_no", "line").repartition("file").sortWithinPartitions("file", "line_no").select("file", "line").mapInPandas(walk, _ATOM_LINES)
    t = F.split(F.trim("line"), r"\s+")
    place = lambda i: F.get(t, F.col("place_at") + i).try_cast("double")
    return atoms.select("file", "frame_idx", "atom_id", F.get(t, F.col("symbol_at")).alias("symbol"), place(0).alias("x"), place(1).alias("y"), place(2).alias("z"), "cell")


def two_columns(df: DataFrame, x: str, y: str, head: str, by: list[str] | None = None) -> DataFrame:
    """(by, text): rows as a text file of two columns with six digits, in the order of x."""
    line = F.format_string("%.6f %.6f", F.col(x), F.col(y))
    rows = F.array_sort(F.collect_list(F.struct(F.col(x).alias("at"), line.alias("line"))))
    return df.groupBy(*(by or [])).agg(F.concat_ws("\n", F.lit(f"# {head}"), F.transform(rows, lambda r: r["line"])).alias("text"))


def numbered_files(names: DataFrame, column: str = "name") -> DataFrame:
    return names.filter(T.is_numbered_output(F.col(column)))


def literal_options(text: str, existing: dict | None = None) -> dict:
    """A dict literal, or the existing options where the text is none."""
    import ast

    try:
        found = ast.literal_eval(text.strip() or "{}")
    except (ValueError, SyntaxError):
        return dict(existing or {})
    return {**(existing or {}), **found} if isinstance(found, dict) else dict(existing or {})


def options(column: Column, fields: str) -> Column:
    """The columnar reading of options: the named fields of a JSON object, all null where
    the text is none."""
    return F.from_json(column, fields, {"mode": "PERMISSIVE"})
