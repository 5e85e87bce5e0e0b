"""Structures as text: writers that give one row of text per structure, readers by format,
and listings of folders. Atoms are rows (by, atom_id, symbol, x, y, z)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StructureError
from ..functions import text as T
from ..operators import sampling
from . import text
from .files import qualified


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files below a path, in the order of their names."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length").orderBy("path")


def _body(line: Column, by_symbol: bool = False) -> Column:
    """The atoms' lines in the order of their ids, or clumped by species."""
    key = ["symbol", "atom_id"] if by_symbol else ["atom_id"]
    rows = F.array_sort(F.collect_list(F.struct(*key, line.alias("line"))))
    return F.concat_ws("\n", F.transform(rows, lambda r: r["line"]))


def _numbers(*columns: str, form: str = "%.6f") -> Column:
    return F.format_string(" ".join([form] * len(columns)), *(F.col(c) for c in columns))


def xyz_text(atoms: DataFrame, by: Sequence[str], cell: Sequence[float] | None = None) -> DataFrame:
    """XYZ, or extended XYZ where an orthogonal cell is given."""
    head = F.lit("") if cell is None else F.lit('Lattice="{} 0.0 0.0 0.0 {} 0.0 0.0 0.0 {}" Properties=species:S:1:pos:R:3 pbc="T T T"'.format(*map(float, cell)))
    line = F.concat_ws(" ", "symbol", _numbers("x", "y", "z"))
    return atoms.groupBy(*by).agg(F.concat_ws("\n", F.count("*").cast("string"), head, _body(line)).alias("text"))


def cif_text(atoms: DataFrame, by: Sequence[str], cell: Sequence[float]) -> DataFrame:
    """CIF without symmetry in an orthogonal cell: scaled coordinates in [0, 1), six
    digits rounded half to even, atoms clumped by species."""
    a, b, c = (float(v) for v in cell)
    scaled = [F.format_string("%.6f", F.bround(F.pmod(F.col(x) / F.lit(n), F.lit(1.0)), 6)) for x, n in zip("xyz", (a, b, c))]
    head = f"data_structure\n_cell_length_a {a:.6f}\n_cell_length_b {b:.6f}\n_cell_length_c {c:.6f}\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90\n_symmetry_space_group_name_H-M 'P 1'\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z"
    line = F.concat_ws(" ", F.concat("symbol", F.col("atom_id").cast("string")), "symbol", *scaled)
    return atoms.groupBy(*by).agg(F.concat_ws("\n", F.lit(head), _body(line, by_symbol=True)).alias("text"))


def lammps_data_text(atoms: DataFrame, by: Sequence[str], species: Sequence[str], cell: Sequence[float]) -> DataFrame:
    """A LAMMPS data file with types numbered from 1 in the order of ``species``."""
    kind = F.array_position(F.array(*(F.lit(s) for s in species)), F.col("symbol"))
    line = F.concat_ws(" ", (F.col("atom_id") + 1).cast("string"), kind.cast("string"), _numbers("x", "y", "z"))
    box = "\n".join(f"0.0 {float(v)} {d}lo {d}hi" for v, d in zip(cell, "xyz"))
    return atoms.groupBy(*by).agg(F.concat(F.lit("structure\n\n"), F.count("*").cast("string"), F.lit(f" atoms\n{len(species)} atom types\n{box}\n\nAtoms\n\n"), _body(line)).alias("text"))


def poscar_text(atoms: DataFrame, by: Sequence[str], cell: Sequence[float]) -> DataFrame:
    """VASP's format, atoms clumped by species."""
    counts = atoms.groupBy(*by, "symbol").agg(F.count("*").alias("n")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("symbol", "n"))).alias("_kinds"))
    body = atoms.groupBy(*by).agg(_body(_numbers("x", "y", "z"), by_symbol=True).alias("body"))
    a, b, c = (float(v) for v in cell)
    box = f"structure\n1.0\n{a} 0.0 0.0\n0.0 {b} 0.0\n0.0 0.0 {c}"
    listed = lambda field: F.concat_ws(" ", F.transform("_kinds", lambda r: r[field].cast("string")))
    names, ns = listed("symbol"), listed("n")
    return counts.join(body, list(by)).select(*by, F.concat_ws("\n", F.lit(box), names, ns, F.lit("Cartesian"), "body").alias("text"))


ATOMS = "file string, frame_idx int, atom_id int, symbol string, x double, y double, z double, cell array<double>"
Sites = tuple[list[str], np.ndarray, np.ndarray]  # symbols, places, the cell's three vectors


def _number(token: str) -> float:
    return float(re.sub(r"\(.*\)", "", token))  # 1.23(4) is 1.23


def _cell(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    ca, cb, cg = (0.0 if v == 90 else math.cos(math.radians(v)) for v in (alpha, beta, gamma))
    sg = math.sqrt(1 - cg * cg)
    cx, cy = cb, (ca - cb * cg) / sg
    return np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cx, c * cy, c * math.sqrt(max(0.0, 1 - cx * cx - cy * cy))]])


def _operation(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The matrix and shift of a symmetry operation such as ``-x, y+1/2, z``."""
    turn, shift = np.zeros((3, 3)), np.zeros(3)
    for i, part in enumerate(text.lower().replace(" ", "").split(",")):
        for sign, term in re.findall(r"([+-]?)([xyz]|\d+/\d+|\d*\.?\d+)", part):
            s = -1.0 if sign == "-" else 1.0
            if term in "xyz":
                turn[i, "xyz".index(term)] += s
            else:
                shift[i] += s * float(Fraction(term))
    return turn, shift


def _cif(lines: Sequence[str]) -> Sites:
    """Every site of the cell: each listed one under all listed operations, one where its
    images coincide."""
    values: dict[str, str] = {}
    loops: list[tuple[list[str], list[list[str]]]] = []
    in_head = False
    for raw in lines:
        line = raw.split(" #")[0].strip()
        t = [a or b or c for a, b, c in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\S+)", line)]
        if not t or line.startswith("#"):
            continue
        if t[0].lower() == "loop_":
            loops.append(([], []))
            in_head = True
        elif t[0].startswith("_"):
            if in_head and len(t) == 1:
                loops[-1][0].append(t[0].lower())
            else:
                in_head = False
                values[t[0].lower()] = " ".join(t[1:])
        elif loops and loops[-1][0]:
            in_head = False
            loops[-1][1].append(t)
    rows = lambda name: next(((names.index(name), names, body) for names, body in loops if name in names), None)
    operations = [_operation("x,y,z")]
    for name in ("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz"):
        found = rows(name)
        if found:
            at, names, body = found
            operations = [_operation(r[at] if len(r) == len(names) else "".join(r[at:])) for r in body]
            break
    else:
        group = values.get("_symmetry_space_group_name_h-m", values.get("_space_group_name_h-m_alt", "P 1"))
        if group.replace(" ", "") not in ("P1", "?", "."):
            raise StructureError(f"space group {group} is named without its operations")
    sites = rows("_atom_site_fract_x")
    if not sites:
        raise StructureError("no atom sites")
    _, names, body = sites
    at = {n: i for i, n in enumerate(names)}
    symbols, places = [], []
    for r in body:
        if len(r) != len(names):
            continue
        kind = r[at["_atom_site_type_symbol"]] if "_atom_site_type_symbol" in at else r[at["_atom_site_label"]]
        kind = re.match(r"[A-Za-z]+", kind).group(0)
        p = np.array([_number(r[at[f"_atom_site_fract_{c}"]]) for c in "xyz"])
        images: list[np.ndarray] = []
        for turn, shift in operations:
            q = p if len(operations) == 1 else (turn @ p + shift) % 1.0
            if not any(np.abs((q - o + 0.5) % 1.0 - 0.5).max() < 1e-3 for o in images):
                images.append(q)
        symbols += [kind] * len(images)
        places += images
    cell = _cell(*(_number(values[f"_cell_length_{c}"]) for c in "abc"), *(_number(values.get(f"_cell_angle_{c}", "90")) for c in ("alpha", "beta", "gamma")))
    return symbols, np.array(places) @ cell, cell


def _poscar(lines: Sequence[str]) -> Sites:
    rows = [x.split() for x in lines]
    scale, cell = float(rows[1][0]), np.array([[float(v) for v in r[:3]] for r in rows[2:5]])
    cell = cell * (scale if scale > 0 else (-scale / abs(np.linalg.det(cell))) ** (1 / 3))  # a negative scale is a volume
    named = not rows[5][0].isdecimal()
    kinds = rows[5] if named else rows[0]
    counts = [int(v) for v in rows[6 if named else 5]]
    at = 7 if named else 6
    at += rows[at][0][0] in "sS"  # selective dynamics
    cartesian = rows[at][0][0] in "cCkK"
    places = np.array([[float(v) for v in r[:3]] for r in rows[at + 1 : at + 1 + sum(counts)]]).reshape(-1, 3)
    factor = scale if scale > 0 else 1.0
    return [k for k, n in zip(kinds, counts) for _ in range(n)], places * factor if cartesian else places @ cell, cell


def _parsed(rows: DataFrame, parse: Callable[[Sequence[str]], Sites]) -> DataFrame:
    """Files that hold one structure, each parsed as a whole: (``ATOMS``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, lines in zip(f["file"], f["lines"]):
                symbols, places, cell = parse(list(lines))
                n = len(symbols)
                yield pd.DataFrame({"file": [file] * n, "frame_idx": 0, "atom_id": range(n), "symbol": symbols, "x": places[:, 0], "y": places[:, 1], "z": places[:, 2], "cell": [cell.ravel().tolist()] * n})

    whole = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return whole.select("file", F.transform("l", lambda x: x["line"]).alias("lines")).mapInPandas(run, ATOMS)


def cif(rows: DataFrame) -> DataFrame:
    """(``ATOMS``) of CIF lines: every site of the cell, of any shape, under the file's
    symmetry operations. A space group that is only named is an error."""
    return _parsed(rows, _cif)


def poscar(rows: DataFrame) -> DataFrame:
    """(``ATOMS``) of VASP structure lines, direct or Cartesian."""
    return _parsed(rows, _poscar)


def _reader(name: str) -> Callable[[DataFrame], DataFrame]:
    last = name.rstrip("/").rsplit("/", 1)[-1].lower()
    if last.endswith(".cif"):
        return cif
    if last.endswith((".vasp", ".poscar")) or last.startswith(("poscar", "contcar")):
        return poscar
    if last.endswith((".xyz", ".extxyz")):
        return text.xyz
    raise StructureError(f"no reader for {last}")


def read_structures(spark: SparkSession, path: str, index: str = ":") -> DataFrame:
    """(``ATOMS``) of structure and trajectory files, by the ending of their name. ``index``
    chooses frames of each file as a Python index or slice does."""
    read = _reader(path)
    rows = text.ordered_lines(spark, path) if read is text.xyz else text.lines(spark, path)
    return sampling.sliced(read(rows), index, ["file"])


def structure_from_bytes(spark: SparkSession, name: str, data: bytes, options: dict | None = None) -> DataFrame:
    """An uploaded file's structure, read by the ending of its ``name``; of the options
    ``index`` chooses frames (the last unless it is given)."""
    rows = spark.createDataFrame([(name, data.decode("utf-8", "replace"))], "file string, value string")
    listed = rows.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return sampling.sliced(_reader(name)(listed), str((options or {}).get("index", "-1")), ["file"])


def write_texts(df: DataFrame, folder: str, name: Column) -> int:
    """One file per row under a folder all executors share; returns how many."""
    folder = qualified(df.sparkSession, folder)

    def run(rows):
        from pyarrow import fs

        n = 0
        for r in rows:
            system, at = fs.FileSystem.from_uri(folder)
            system.create_dir(f"{at}/{r['name']}".rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{at}/{r['name']}") as f:
                f.write((r["text"] + "\n").encode())
            n += 1
        yield n

    return sum(df.select(name.alias("name"), "text").rdd.mapPartitions(run).collect())  # a count per partition


def remove_outputs(spark: SparkSession, folder: str, keep_essential: bool = True) -> int:
    """Deletes the intermediate files of finished solver runs below a folder (numbered
    path files; unless only these should go, logs and the like too); returns how many."""
    gone = inventory(spark, folder).filter(T.is_removable(F.col("name"), keep_essential))

    def run(rows):
        from pyarrow import fs

        n = 0
        for r in rows:
            path = re.sub(r"^file:/+", "file:///", r["path"])
            system, at = fs.FileSystem.from_uri(path)
            system.delete_file(at)
            n += 1
        yield n

    return sum(gone.select("path").rdd.mapPartitions(run).collect())  # a count per partition


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length): what solver runs below a folder wrote, sorted by path,
    without their input and log."""
    return inventory(spark, folder).filter(~F.col("name").isin("feff.inp", "feff.log"))
