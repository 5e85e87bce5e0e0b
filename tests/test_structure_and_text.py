import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chiweave.errors import ProcessingError
from chiweave.operators import cards, spectra, structure
from chiweave.sources import text


def rows(spark, body, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(body.split("\n"))], "file string, line_no int, line string")


DUMP = """ITEM: TIMESTEP
{step}
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp pp
0.0 1.0
0.0 1.0
0.0 1.0
ITEM: ATOMS id type xs ys zs fx fy fz
7 2 0.1 0.2 0.3 1 2 3
3 1 0.4 0.5 0.6 4 5 6
"""


def test_dump_reads_every_frame(spark, tmp_path):
    (tmp_path / "d.dump").write_text(DUMP.format(step=10) + DUMP.format(step=20))
    got = text.lammps_dump(spark, str(tmp_path / "d.dump")).orderBy("timestep", "atom_id").collect()
    assert [(r["timestep"], r["atom_id"], r["type"], r["xs"], r["fz"]) for r in got] == [(10, 3, 1, 0.4, 6.0), (10, 7, 2, 0.1, 3.0), (20, 3, 1, 0.4, 6.0), (20, 7, 2, 0.1, 3.0)]
    first = text.first_frame_types(text.lines(spark, str(tmp_path / "d.dump"))).collect()
    assert sorted((r["atom_id"], r["type"]) for r in first) == [(3, 1), (7, 2)]


def test_xyz_frames(spark):
    body = "2\n0\nFe 0 0 0\nO 1.5 0 0\n\n2\n1\nFe 0 0 1\nO 1.5 0 1\n"  # comments that are whole numbers
    got = text.xyz(rows(spark, body)).orderBy("frame_idx", "atom_id").collect()
    assert [(r["frame_idx"], r["atom_id"], r["symbol"], r["x"], r["z"]) for r in got] == [(0, 0, "Fe", 0.0, 0.0), (0, 1, "O", 1.5, 0.0), (1, 0, "Fe", 0.0, 1.0), (1, 1, "O", 1.5, 1.0)]


def test_extended_xyz_keeps_cell_and_columns(spark):
    body = '1\nLattice="4 0 0 0 5 0 0 0 6" Properties=id:I:1:pos:R:3:species:S:1 pbc="T T T"\n9 1 2 3 Fe\n1\nplain\nO 1 2 3\nstray line\n1\nc\nFe 0 0 0'
    got = text.xyz(rows(spark, body)).orderBy("frame_idx").collect()
    assert [(r["symbol"], r["x"], r["z"], r["cell"]) for r in got] == [("Fe", 1.0, 3.0, [4, 0, 0, 0, 5, 0, 0, 0, 6]), ("O", 1.0, 3.0, None)]


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    body = "".join(f"3\nframe {i}\n" + "".join(f"Fe {i} {j} 0\n" for j in range(3)) for i in range(4000))
    (tmp_path / "t.xyz").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = text.ordered_lines(spark, str(tmp_path / "t.xyz"))
        assert raw.rdd.getNumPartitions() > 4
        got = text.xyz(raw).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["frame_idx"], r["atom_id"], r["x"], r["y"]) for r in got) == [(i, j, float(i), float(j)) for i in range(4000) for j in range(3)]


def test_rdf_skips_what_is_no_row(spark):
    good = "1 0.5 1 2 3 4 5 6 7 8"
    got = text.rdf(rows(spark, f"# c\n100 2\n{good}\n1 2 3 4 5 6 7 8 9 x")).collect()
    assert len(got) == 1 and got[0]["cn22"] == 8.0
    with pytest.raises(ProcessingError):
        text.rdf(rows(spark, "# only"), strict=True)


def test_msd_and_run_info(spark):
    m = text.msd(rows(spark, "# t\n1 0.1 0.2 0.3\n2 0.4 0.6 0.5\n"), 0.5).collect()[0]
    assert (m["timestep"], m["largest"], m["species"], m["drifting"]) == (2, 0.6, "ag", True)
    deck = "variable TEMP equal 100\nvariable TEMP equal 300\ntimestep 0.002\nvariable NUMMDSTEPS equal 1000\npair_style x/y\npair_coeff * * m.json Ag Au"
    r = text.run_info(rows(spark, deck)).collect()[0]
    assert (r["temp"], r["nsteps"], r["pair_style"], r["species"], r["averaging_time"]) == (300.0, 1000, "x/y", ["Ag1", "Au2"], 2.0)
    assert text.pair_species(rows(spark, deck)).collect()[0]["species"] == ["Ag", "Au"]


def test_cards_match_whole_tags_and_missing_ones_follow_the_edge(spark):
    body = "TITLE x\nEDGE      K\nSCF       5.0\nS02       1.0"
    out = cards.joined(cards.rewritten(rows(spark, body), {"S02": "0.8", "NLEG": "4", "EXAFS": "20"})).collect()[0]["text"]
    assert out.split("\n") == ["TITLE x", "EDGE      K", "EXAFS     20", "NLEG      4", "SCF       5.0", "S02       0.8"]
    assert [r["tag"] for r in text.feff_cards(rows(spark, "* c\nEDGE K\nRPATH 8.0")).collect()] == ["EDGE", "RPATH"]


def test_settings_merge(spark):
    m = spark.range(1).select(cards.merged(F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("2")), F.create_map(F.lit("B"), F.lit("3"), F.lit("COREHOLE"), F.lit("x")), F.lit("9"))).collect()[0][0]
    assert m == {"A": "1", "B": "3", "RPATH": "9"}


PATH = """ header
   2   6.000   2.0000    2.3017   -1.02520 nleg, deg, reff, rnrmav(bohr), edge
        x         y         z   pot at#
     0.0000    0.0000    0.0000  0  26 Fe       absorbing atom
    k   real[2*phc]   mag[feff]  phase[feff] red factor   lambda     real[p]@#
  0.000  0.0  0.5 0.0 1.0 10.0 1.0
  5.000  0.0  0.5 0.0 1.0 10.0 1.0
 10.000  0.0  0.5 0.0 1.0 10.0 1.0"""


def test_path_sum_is_the_published_equation(spark):
    paths, points = text.feff_paths(rows(spark, PATH, "/d/feff0001.dat"))
    k = [0.0, 1.0, 2.5]
    got = [r["chi"] for r in spectra.path_sum(points, paths, k).orderBy("k_idx").collect()]
    want = [0.0] + [6 * 0.5 / (x * 4) * math.exp(-0.4) * math.sin(4 * x) for x in k[1:]]
    assert np.allclose(got, want, atol=1e-12)


def test_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-2, 2, (60, 3))
    df = spark.createDataFrame([(0, i, *map(float, p[i])) for i in range(60)], "s int, atom_id int, x double, y double, z double")
    got = {(r["centre_id"], r["atom_id"]) for r in structure.neighbours(df, df, 0.7, ["s"]).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {(i, j) for i in range(60) for j in range(60) if d[i, j] <= 0.7}


def test_assignment_edges(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,)], "d double")
    assert [r[0] for r in df.select(structure.core_shell(F.col("d"), 0.5)).collect()] == [1, 2]
    with pytest.raises(ValueError):
        structure.hemisphere(F.lit(0), F.lit(0), F.lit(0), (0, 0, 0))


def test_rigid_motion_has_no_displacement(spark):
    atoms = [(0, f, i, 1, float(i) + f, float(-i) + f, float(f)) for f in range(3) for i in range(4)]
    df = spark.createDataFrame(atoms, "s int, frame_idx int, atom_id int, type int, x double, y double, z double")
    assert all(abs(r["msd"]) < 1e-12 for r in structure.mean_squared_displacement(df, ["s"]).collect())


def test_truncated_clusters_have_the_known_sizes(spark):
    # Cuboctahedra and octahedra of fcc; a bcc cube; and planes counted between lattice points.
    assert structure.truncated_cluster(spark, "fcc", 4.0, [(1, 0, 0), (1, 1, 1)], [2, 2])[0].count() == 55
    assert structure.truncated_cluster(spark, "fcc", 4.0, [(1, 1, 1)], [1])[0].count() == 13 + 6
    assert structure.truncated_cluster(spark, "bcc", 3.0, [(1, 0, 0)], [2])[0].count() == 27 + 8
    assert structure.plane_distance("fcc", 4.0, (1, 0, 0)) == 2.0 and structure.plane_distance("sc", 4.0, (1, 0, 0)) == 4.0
    for bad in (dict(surfaces=[], layers=[]), dict(surfaces=[(1, 0, 0)], layers=[1], pbc=True)):
        with pytest.raises(ValueError):
            structure.truncated_cluster(spark, "fcc", 4.0, **bad)


def test_slices_of_frames(spark):
    from chiweave.operators import sampling

    df = spark.range(10).withColumnRenamed("id", "frame_idx")
    for index in (":", "::3", "2:", ":4", "-3:", ":-2", "-7:-1:2", "1:9:4", "5:2"):
        want = list(range(10))[slice(*(int(p) if p else None for p in index.split(":")))]
        assert sorted(r[0] for r in sampling.sliced(df, index).collect()) == want, index
    assert [r[0] for r in sampling.sliced(df, "-2").collect()] == [8]


def test_lattice_has_the_known_shells(spark):
    n = structure.lattice_cluster(spark, "fcc", 2**0.5, 3, 1.01).count()
    assert n == 13  # an atom and its twelve neighbours at distance 1


def test_literal_options():
    assert text.literal_options("{'a': 1}", {"b": 2}) == {"a": 1, "b": 2}
    assert text.literal_options("open('x')", {"b": 2}) == {"b": 2} and text.literal_options("[1]") == {}


def test_running_mean_streams(spark, tmp_path):
    from chiweave.streaming import running_mean as R

    rows_ = [("t", i, j, 0.05 * j, float(i)) for i in range(4) for j in range(2)]
    spark.createDataFrame(rows_, R.POINTS).write.parquet(str(tmp_path / "in"))
    q = R.running_mean(R.watched_points(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("mean_so_far").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k_idx"], r["chi"], r["nframes"]) for r in spark.table("mean_so_far").collect()} == {(0, 1.5, 4), (1, 1.5, 4)}
