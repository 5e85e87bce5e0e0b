import sys

import pytest
from pyspark.sql import functions as F

from chiweave.config import SpectrumConfig
from chiweave.errors import StructureError
from chiweave.plans import cli
from chiweave.plans.inputs import settings, solver_inputs
from chiweave.plans.pipeline import Analyzer, percent
from chiweave.sources import structures, text


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(0, 0, "O", 1.0, 0.0, 0.0), (0, 1, "Fe", 0.0, 0.0, 0.0), (0, 2, "Fe", 0.0, 2.0, 0.0), (0, 3, "O", 9.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "s int, atom_id int, symbol string, x double, y double, z double")


def test_settings_put_user_cards_on_top():
    c = SpectrumConfig(method="pymatgen", radius=6.0, user_tag_settings={"S02": "0.8", "COREHOLE": "FSR"})
    assert settings(c)["S02"] == "0.8" and settings(c)["RPATH"] == "6" and "SCF" in settings(c) and "COREHOLE" not in settings(c)
    assert "SCF" not in settings(SpectrumConfig())


def test_cluster_input_reads_back(spark, atoms):
    out = solver_inputs(atoms, "fe", SpectrumConfig(radius=3.0), ["s"])
    body = out.collect()[0]["text"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(body.split("\n"))], "file string, line_no int, line string")
    got = text.feff_atoms(lines).orderBy("distance").collect()
    assert [(r["tag"], r["ipot"], r["distance"]) for r in got] == [("Fe", 0, 0.0), ("O", 2, 1.0), ("Fe", 1, 2.0)]
    assert {"EDGE", "RPATH", "POTENTIALS", "ATOMS"} <= {r["tag"] for r in text.feff_cards(lines).collect()}
    assert solver_inputs(atoms, "0", SpectrumConfig(radius=1.5), ["s"]).collect()[0]["text"].count("Fe") == 2


def test_structures_round_trip(spark, atoms, tmp_path):
    n = structures.write_texts(structures.xyz_text(atoms, ["s"]), str(tmp_path), F.format_string("s%03d.xyz", "s"))
    assert n == 1
    back = text.xyz(text.lines(spark, str(tmp_path / "s000.xyz"))).orderBy("atom_id").collect()
    assert [(r["symbol"], r["x"], r["y"]) for r in back] == [("O", 1.0, 0.0), ("Fe", 0.0, 0.0), ("Fe", 0.0, 2.0), ("O", 9.0, 0.0)]
    assert [r["name"] for r in structures.inventory(spark, str(tmp_path), "*.xyz").collect()] == ["s000.xyz"]
    assert "Lattice=" in structures.xyz_text(atoms, ["s"], (10, 10, 10)).collect()[0]["text"]
    structures.write_texts(structures.cif_text(atoms, ["s"], (10, 20, 30)), str(tmp_path), F.lit("a.cif"))
    sites = structures.cif(text.lines(spark, str(tmp_path / "a.cif"))).orderBy("atom_id").collect()
    assert [(r["symbol"], round(r["x"], 6), round(r["y"], 6)) for r in sites] == [("Fe", 0.0, 0.0), ("Fe", 0.0, 2.0), ("O", 1.0, 0.0), ("O", 9.0, 0.0)]


def test_simulation_formats(atoms):
    data = structures.lammps_data_text(atoms, ["s"], ["Fe", "O"], (10, 10, 10)).collect()[0]["text"]
    assert "4 atoms\n2 atom types\n0.0 10.0 xlo xhi" in data and "\n1 2 1.000000 0.000000 0.000000\n" in data
    poscar = structures.poscar_text(atoms, ["s"], (10, 10, 10)).collect()[0]["text"]
    assert "\nFe O\n2 2\nCartesian\n0.000000 0.000000 0.000000\n" in poscar


CIF = """data_x
_cell_length_a 4.0
_cell_length_b 4.0
_cell_length_c 6.0
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 120
_symmetry_space_group_name_H-M 'P -3'
loop_
_symmetry_equiv_pos_as_xyz
'x, y, z'
'-y, x-y, z'
'-x+y, -x, z'
'-x, -y, -z'
'y, -x+y, -z'
'x-y, x, -z'
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Fe1 0 0 0
O1 0.3333(1) 0.6667 0.25
"""


def test_cif_symmetry_and_oblique_cells(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    got = structures.read_structures(spark, str(tmp_path / "a.cif")).collect()
    assert sorted(r["symbol"] for r in got) == ["Fe", "O", "O"]  # a special position and a pair
    b = got[0]["cell"][3:6]
    assert abs(b[0] + 2.0) < 1e-9 and abs(b[1] - 4 * 3**0.5 / 2) < 1e-9
    (tmp_path / "b.cif").write_text("\n".join(x for x in CIF.split("\n") if "'" not in x or "P -3" in x).replace("loop_\n_symmetry_equiv_pos_as_xyz\n", ""))
    with pytest.raises(Exception, match="without its operations"):
        structures.read_structures(spark, str(tmp_path / "b.cif")).collect()


def test_poscar_direct_and_cartesian(spark, tmp_path):
    head = "x\n2.0\n2 0 0\n0 2 0\n0 0 2\nFe O\n1 1\n"
    for name, mode, row in (("POSCAR", "Selective dynamics\nDirect", "0.25 0 0 T T T"), ("b.vasp", "Cartesian", "0.5 0 0")):
        (tmp_path / name).write_text(f"{head}{mode}\n0 0 0\n{row}\n")
        got = structures.read_structures(spark, str(tmp_path / name)).orderBy("atom_id").collect()
        assert [(r["symbol"], r["x"]) for r in got] == [("Fe", 0.0), ("O", 1.0)]


def test_uploaded_bytes(spark):
    data = b"1\n5\nFe 0 0 0\n1\n6\nFe 1 0 0\n"
    assert [r["x"] for r in structures.structure_from_bytes(spark, "up.xyz", data).collect()] == [1.0]
    assert [r["x"] for r in structures.structure_from_bytes(spark, "up.xyz", data, {"index": 0}).collect()] == [0.0]
    with pytest.raises(StructureError):
        structures.structure_from_bytes(spark, "up.doc", data)


def test_outputs_are_listed_and_removed(spark, tmp_path):
    for d in ("frame_0000", "frame_0001"):
        (tmp_path / d).mkdir()
        for n in ("feff0001.dat", "FEFF0002.DAT", "log1.dat", "misc.dat", "feffrun_x.log", "chi.dat", "feff.inp"):
            (tmp_path / d / n).write_text(n)
    assert [r["name"] for r in structures.run_log(spark, str(tmp_path)).collect()].count("feff.inp") == 0
    assert structures.remove_outputs(spark, str(tmp_path)) == 10
    assert sorted(p.name for p in (tmp_path / "frame_0001").iterdir()) == ["chi.dat", "feff.inp"]


SOLVER = """import re
atoms = open('feff.inp').read().split('ATOMS')[1].split()
if '9.00000' in atoms: raise SystemExit('too far')
open('chi.dat', 'w').write('# k chi\\n' + ''.join(f'{0.05 * i} {i * 0.01}\\n' for i in range(60)))
"""


@pytest.fixture
def solver(tmp_path):
    (tmp_path / "solver.py").write_text(SOLVER)
    return f"{sys.executable} {tmp_path}/solver.py"


TRAJECTORY = "2\n0\nFe 0 0 0\nO 1 0 0\n2\n1\nFe 0 0 0\nO 9 0 0\n2\n2\nFe 0 0 0\nO 2 0 0\n"


def test_commands_from_structure_to_transform(spark, tmp_path, solver, capsys):
    (tmp_path / "t.xyz").write_text(TRAJECTORY)
    out, cache, xyz = str(tmp_path / "out"), str(tmp_path / "cache"), str(tmp_path / "t.xyz")
    args = ["process", xyz, "Fe", "--output", out, "--solver", solver, "--radius", "10", "--kmin", "0.5", "--kmax", "2.5", "--cache-dir", cache]
    assert cli.main([*args, "--trajectory"]) == 0
    assert '"nframes": 2' in (said := capsys.readouterr()).out and '"cache_misses": 3' in said.out and "100 %" in said.err
    assert (tmp_path / "out" / "exafs_data.dat").exists() and (tmp_path / "out" / "ft_data.dat").read_text().startswith("# R chir_mag")
    assert cli.main(args) == 0  # the last frame, from the cache
    assert '"cache_hits": 1' in capsys.readouterr().out
    assert cli.main(["process", xyz, "Cu", "--output", out, "--solver", solver]) == 1

    assert cli.main(["generate", xyz, "Fe", "--output", str(tmp_path / "in"), "--radius", "10"]) == 0
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["frame_0000", "frame_0001", "frame_0002"]
    (tmp_path / "in" / "frame_0000" / "feff0001.dat").write_text("x")
    assert cli.main(["run-feff", str(tmp_path / "in"), "--solver", solver]) == 0
    assert '"succeeded": 2, "failed": 1' in capsys.readouterr().out
    assert sorted(p.name for p in (tmp_path / "in" / "frame_0000").iterdir() if not p.name.endswith(".crc")) == ["chi.dat", "feff.inp"]
    assert cli.main(["process-output", str(tmp_path / "in"), "--output", out, "--kmin", "0.5", "--kmax", "2.5", "--traces", "--with-phase"]) == 0
    assert '"nframes": 2' in capsys.readouterr().out and (tmp_path / "out" / "traces.parquet").exists()
    assert cli.main(["process-output", str(tmp_path / "none"), "--output", out]) == 1


def test_atoms_as_rows_and_progress(spark):
    rows = [(f, i, s, float(i + f), 0.0, 0.0) for f in range(3) for i, s in enumerate(("Fe", "O"))]
    atoms = spark.createDataFrame(rows, "frame_idx long, atom_id int, symbol string, x double, y double, z double")
    said = []
    runner = lambda body, absorber, config: ([0.0, 0.05, 0.1], [0.0, 1.0, 2.0])
    got = Analyzer(spark, runner=runner).process(atoms, "Fe", SpectrumConfig(parallel=False), trajectory=True, progress=lambda *x: said.append(x))
    assert got.nframes == 3 and said[-1][:2] == (3, 3) and percent(1, 4) == 25.0
