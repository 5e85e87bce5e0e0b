"""Queries over atoms: centres, assignment, neighbours, distributions, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SpectrumConfig
from ..functions import numeric as N
from ..operators import sampling as S
from ..operators import structure as A
from ..sources import structures as W
from ..sources import text as R
from .inputs import solver_inputs
from .registry import ATOMS, Tables, query, r6

CENTRED = f"WITH {ATOMS}, c AS (SELECT s, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM atoms GROUP BY s), d AS (SELECT a.*, x - cx AS dx, y - cy AS dy, z - cz AS dz, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS dist FROM atoms a JOIN c ON a.s = c.s)"
PAIRS = f"WITH {ATOMS}, p AS (SELECT a.s, a.atom_id AS centre_id, b.atom_id, a.type AS type_a, b.type AS type_b, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS dist FROM atoms a JOIN atoms b ON a.s = b.s)"
SPECIES = ("Ag", "Au")


def _named(t: Tables) -> DataFrame:
    return t.atoms().withColumn("symbol", A.species_of(F.col("type"), SPECIES))


NAMED = f"WITH {ATOMS}, named AS (SELECT *, CASE type WHEN 1 THEN 'Ag' ELSE 'Au' END AS symbol FROM atoms)"


@query("f10_core_shell", f"{CENTRED} SELECT s, atom_id, CASE WHEN dist < 0.2e0 THEN 2 ELSE 1 END AS side FROM d")
def _(t: Tables) -> DataFrame:
    return A.from_centre(t.atoms(), ["s"]).select("s", "atom_id", A.core_shell(F.col("dist"), 0.2).alias("side"))


@query("f11_x12_hemisphere", f"{CENTRED} SELECT s, atom_id, CASE WHEN dx * (1.0e0 / 3.0e0) + dy * (2.0e0 / 3.0e0) + dz * (2.0e0 / 3.0e0) >= 0 THEN 1 ELSE 2 END AS side FROM d")
def _(t: Tables) -> DataFrame:
    side = A.hemisphere(F.col("dx"), F.col("dy"), F.col("dz"), (1, 2, 2))
    return A.from_centre(t.atoms(), ["s"]).select("s", "atom_id", side.alias("side"))


@query("f12_absorber_check", "SELECT l_orderkey AS s, list_contains(list(l_returnflag), 'R') AS by_symbol, 2 < count(*) AS by_site, false AS absent FROM lineitem GROUP BY l_orderkey")
def _(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("s")).agg(F.collect_list("l_returnflag").alias("symbols"))
    return g.select("s", *(A.absorber_ok(F.col("symbols"), a).alias(n) for a, n in (("r", "by_symbol"), ("2", "by_site"), ("Xx", "absent"))))


@query("f15_atom_count_invariant", "SELECT o_custkey, min(n) AS fewest, max(n) AS most FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey HAVING min(n) <> max(n)")
def _(t: Tables) -> DataFrame:
    both = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return S.unequal_counts(both, ["o_custkey"], "o_orderkey")




@query("f16_u3_equal_id_sets", """WITH a AS (SELECT o_custkey, o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey), e AS (SELECT o_custkey, min(o_orderkey) AS f, max(o_orderkey) AS l FROM a GROUP BY o_custkey)
  SELECT o_custkey, list_sort(list(l_linenumber) FILTER (o_orderkey = f)) = list_sort(list(l_linenumber) FILTER (o_orderkey = l)) AS same FROM a JOIN e USING (o_custkey) GROUP BY o_custkey""")
def _(t: Tables) -> DataFrame:
    both = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return S.equal_id_sets(both, ["o_custkey"], "o_orderkey", "l_linenumber")


@query("j3_p4_species_lookup", "SELECT n_nationkey, n_name, CASE n_regionkey + 1 WHEN 1 THEN 'Ag' WHEN 2 THEN 'Au' END AS species FROM nation")
def _(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", "n_name", A.species_of(F.col("n_regionkey") + 1, SPECIES).alias("species"))


@query("j3_species_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("j6_x11_centre_distance", f"{CENTRED} SELECT s, atom_id, round(dist, 6) + 0.0 AS dist FROM d")
def _(t: Tables) -> DataFrame:
    return A.from_centre(t.atoms(), ["s"]).select("s", "atom_id", r6("dist").alias("dist"))


@query("j7_cluster_within_radius", f"{PAIRS} SELECT s, centre_id, atom_id, round(dist, 6) + 0.0 AS dist FROM p WHERE dist <= 0.15e0")
def _(t: Tables) -> DataFrame:
    a = t.atoms()
    return A.neighbours(a, a, 0.15, ["s"]).select("s", "centre_id", "atom_id", r6("dist").alias("dist"))


@query("j8_e5_radial_distribution", f"""{PAIRS}, h AS (SELECT s, type_a, type_b, CAST(floor(dist / (0.3e0 / 20)) AS INTEGER) AS bin, count(*) AS pairs FROM p WHERE centre_id <> atom_id AND dist <= 0.3e0 AND floor(dist / (0.3e0 / 20)) < 20 GROUP BY ALL),
  n AS (SELECT s, type AS type_a, count(*) AS n FROM atoms GROUP BY ALL)
  SELECT h.s, h.type_a, type_b, bin, round((bin + 0.5e0) * (0.3e0 / 20), 6) AS r, pairs, round(CAST(sum(pairs) OVER (PARTITION BY h.s, h.type_a, type_b ORDER BY bin) AS DOUBLE) / n, 6) AS cn FROM h JOIN n ON h.s = n.s AND h.type_a = n.type_a""")
def _(t: Tables) -> DataFrame:
    g = A.radial_distribution(t.atoms(), 0.3, 20, ["s"])
    return g.select("s", "type_a", "type_b", "bin", r6("r").alias("r"), "pairs", r6("cn").alias("cn"))


@query("e6_mean_squared_displacement", """WITH a AS (SELECT label AS s, vec_id AS frame_idx, CAST(j AS INTEGER) AS atom_id, CAST(j % 2 + 1 AS INTEGER) AS type, CAST(embedding[3 * j + 1] AS DOUBLE) AS x, CAST(embedding[3 * j + 2] AS DOUBLE) AS y, CAST(embedding[3 * j + 3] AS DOUBLE) AS z FROM embeddings, (SELECT unnest(range(21)) AS j)),
  c AS (SELECT s, frame_idx, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM a GROUP BY ALL), d AS (SELECT a.s, a.frame_idx, atom_id, type, x - cx AS dx, y - cy AS dy, z - cz AS dz FROM a JOIN c USING (s, frame_idx)),
  f AS (SELECT s, min(frame_idx) AS frame_idx FROM d GROUP BY s), o AS (SELECT d.s, atom_id, dx AS ox, dy AS oy, dz AS oz FROM d JOIN f USING (s, frame_idx))
  SELECT d.s, frame_idx, type, round(avg((dx - ox) * (dx - ox) + (dy - oy) * (dy - oy) + (dz - oz) * (dz - oz)), 6) + 0.0 AS msd FROM d JOIN o ON d.s = o.s AND d.atom_id = o.atom_id GROUP BY d.s, frame_idx, type""")
def _(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("label").alias("s"), F.col("vec_id").alias("frame_idx"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("atom_id"))
    at = lambda i: F.get("embedding", F.col("atom_id") * 3 + i).cast("double")
    atoms = e.select("s", "frame_idx", "atom_id", (F.col("atom_id") % 2 + 1).cast("int").alias("type"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    return A.mean_squared_displacement(atoms, ["s"]).select("s", "frame_idx", "type", r6("msd").alias("msd"))


@query("a5_centroid", f"WITH {ATOMS} SELECT s, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, round(avg(z), 6) + 0.0 AS cz FROM atoms GROUP BY s")
def _(t: Tables) -> DataFrame:
    return A.centroid(t.atoms(), ["s"]).select("s", *(r6(c).alias(c) for c in ("cx", "cy", "cz")))


@query("a7_u1_distinct_species", "SELECT o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS species FROM orders GROUP BY o_orderpriority")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("species"))


@query("u1_union_of_species", "SELECT n_name AS name FROM nation WHERE n_regionkey < 3 UNION SELECT n_name FROM nation WHERE n_regionkey > 1")
def _(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_name").alias("name"), "n_regionkey")
    return n.filter("n_regionkey < 3").select("name").union(n.filter("n_regionkey > 1").select("name")).distinct()


@query("a8_group_counts", f"{CENTRED} SELECT s, CASE WHEN dist < 0.2e0 THEN 2 ELSE 1 END AS side, count(*) AS n FROM d GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return A.from_centre(t.atoms(), ["s"]).groupBy("s", A.core_shell(F.col("dist"), 0.2).alias("side")).agg(F.count("*").alias("n"))


@query("a12_composition", f"WITH {ATOMS}, n AS (SELECT s, CASE type WHEN 1 THEN 'Ag' ELSE 'Au' END AS symbol, count(*) AS n FROM atoms GROUP BY ALL) SELECT s, symbol, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY s), 6) AS share FROM n")
def _(t: Tables) -> DataFrame:
    return A.composition(_named(t), ["s"]).select("s", "symbol", "n", r6("share").alias("share"))


@query("l1_sorted_by_id", f"WITH {ATOMS} SELECT s, atom_id, row_number() OVER (PARTITION BY s ORDER BY atom_id) AS place FROM atoms")
def _(t: Tables) -> DataFrame:
    return t.atoms().select("s", "atom_id", F.row_number().over(Window.partitionBy("s").orderBy("atom_id")).cast("long").alias("place"))


@query("l2_clumped_by_species", f"WITH {ATOMS} SELECT s, atom_id, type, row_number() OVER (PARTITION BY s ORDER BY type, atom_id) AS place FROM atoms")
def _(t: Tables) -> DataFrame:
    return t.atoms().select("s", "atom_id", "type", F.row_number().over(Window.partitionBy("s").orderBy("type", "atom_id")).cast("long").alias("place"))


@query("l4_random_share", f"WITH {ATOMS} SELECT s, atom_id, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(atom_id AS VARCHAR) || '-0'), atom_id) <= round_even(0.3e0 * count(*) OVER (PARTITION BY s), 0) AS chosen FROM atoms")
def _(t: Tables) -> DataFrame:
    return S.random_share(t.atoms(), 0.3, "atom_id", ["s"]).select("s", "atom_id", "chosen")


@query("x12_dot_product", "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 6) + 0.0 AS dot FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def _(t: Tables) -> DataFrame:
    one = F.broadcast(t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("b")))  # one row
    return t.embeddings.join(one).select("vec_id", r6(N.dot(F.col("embedding"), F.col("b"))).alias("dot"))


@query("p5_rounded_coordinates", f"WITH {ATOMS} SELECT s, atom_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM atoms")
def _(t: Tables) -> DataFrame:
    return t.atoms().select("s", "atom_id", *((F.bround(F.col(c), 6) + F.lit(0.0)).alias(c) for c in ("x", "y", "z")))


#: Sites of an fcc lattice of edge 4.08 in 13 cells a side.
_FCC = "fcc AS (SELECT (i + a) * 4.08e0 AS x, (j + b) * 4.08e0 AS y, (k + c) * 4.08e0 AS z FROM (SELECT unnest(range(-6, 7)) AS i), (SELECT unnest(range(-6, 7)) AS j), (SELECT unnest(range(-6, 7)) AS k), (VALUES (0.0e0, 0.0e0, 0.0e0), (0.5e0, 0.5e0, 0.0e0), (0.5e0, 0.0e0, 0.5e0), (0.0e0, 0.5e0, 0.5e0)) AS v(a, b, c))"


@query("s16_lattice_cluster", f"WITH {_FCC} SELECT round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, 'Au' AS symbol FROM fcc WHERE sqrt(x * x + y * y + z * z) <= 8")
def _(t: Tables) -> DataFrame:
    return A.lattice_cluster(t.spark, "fcc", 4.08, 3, 8.0).select(r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), "symbol")


@query("s16_truncated_cluster", f"""WITH {_FCC}, kept AS (SELECT * FROM fcc WHERE greatest(abs(x), abs(y), abs(z)) <= 3 * 2.04e0 + 1e-6 AND (abs(x) + abs(y) + abs(z)) / sqrt(3) <= 4 * 4.08e0 / sqrt(3) + 1e-6)
  SELECT round(x - min(x) OVER () + 5, 6) + 0.0 AS x, round(y - min(y) OVER () + 5, 6) + 0.0 AS y, round(z - min(z) OVER () + 5, 6) + 0.0 AS z, round(max(x) OVER () - min(x) OVER () + 10, 6) AS cell FROM kept""")
def _(t: Tables) -> DataFrame:
    atoms, cell = A.truncated_cluster(t.spark, "fcc", 4.08, [(1, 0, 0), (1, 1, 1)], [3, 4], "Ag", vacuum=5.0, pbc=True)
    return atoms.select(r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), r6(F.lit(cell[0])).alias("cell"))


@query("k8_xyz_text", f"{NAMED} SELECT s, count(*) || chr(10) || chr(10) || string_agg(symbol || ' ' || printf('%.6f %.6f %.6f', x, y, z), chr(10) ORDER BY atom_id) AS text FROM named GROUP BY s")
def _(t: Tables) -> DataFrame:
    return W.xyz_text(_named(t), ["s"])


_SITES = f"{NAMED} SELECT CAST(s AS VARCHAR) AS file, symbol, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM named"


def _read_back(texts: DataFrame, read) -> DataFrame:
    """Structures written as text, read again: file, symbol and places."""
    lines = texts.select(F.col("s").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return read(lines).select("file", "symbol", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@query("s1_k8_extxyz_frames", f"{NAMED} SELECT CAST(s AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY s ORDER BY atom_id) - 1 AS INTEGER) AS atom_id, symbol, round(x, 6) + 0.0 AS x, 9.0e0 AS cell_y FROM named")
def _(t: Tables) -> DataFrame:
    texts = W.xyz_text(_named(t), ["s"], (8.0, 9.0, 10.0))
    lines = texts.select(F.col("s").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return R.xyz(lines).select("file", "atom_id", "symbol", r6("x").alias("x"), F.get("cell", F.lit(4)).alias("cell_y"))


@query("s1_k8_poscar_sites", _SITES)
def _(t: Tables) -> DataFrame:
    return _read_back(W.poscar_text(_named(t), ["s"], (8.0, 9.0, 10.0)), W.poscar)


@query("s1_k6_cif_sites", f"{NAMED} SELECT CAST(s AS VARCHAR) AS file, symbol, count(*) AS n, round(sum(round(round_even(CASE WHEN x < 0 THEN 1 + x / 8 ELSE x / 8 END, 6) * 8, 6)), 4) AS total FROM named GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    back = _read_back(W.cif_text(_named(t), ["s"], (8.0, 9.0, 10.0)), W.cif)
    return back.groupBy("file", "symbol").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


_CIF_HEAD = "data_structure\n_cell_length_a 8.000000\n_cell_length_b 9.000000\n_cell_length_c 10.000000\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90\n_symmetry_space_group_name_H-M ''P 1''\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n"


def _scaled(c: str, n: int) -> str:
    return f"round_even(CASE WHEN {c} < 0 THEN ({c} / {n}.0e0) % 1 + 1 ELSE ({c} / {n}.0e0) % 1 END, 6)"


@query("k6_p5_cif_text", f"{NAMED} SELECT s, '{_CIF_HEAD}' || string_agg(symbol || atom_id || ' ' || symbol || ' ' || printf('%.6f %.6f %.6f', {_scaled('x', 8)}, {_scaled('y', 9)}, {_scaled('z', 10)}), chr(10) ORDER BY symbol, atom_id) AS text FROM named GROUP BY s")
def _(t: Tables) -> DataFrame:
    return W.cif_text(_named(t), ["s"], (8.0, 9.0, 10.0))


@query("k7_lammps_data_text", f"{NAMED} SELECT s, 'structure' || chr(10) || chr(10) || count(*) || ' atoms' || chr(10) || '2 atom types' || chr(10) || '0.0 8.0 xlo xhi' || chr(10) || '0.0 9.0 ylo yhi' || chr(10) || '0.0 10.0 zlo zhi' || chr(10) || chr(10) || 'Atoms' || chr(10) || chr(10) || string_agg((atom_id + 1) || ' ' || type || ' ' || printf('%.6f %.6f %.6f', x, y, z), chr(10) ORDER BY atom_id) AS text FROM named GROUP BY s")
def _(t: Tables) -> DataFrame:
    return W.lammps_data_text(_named(t), ["s"], SPECIES, (8.0, 9.0, 10.0))


@query("k8_poscar_text", f"{NAMED}, k AS (SELECT s, symbol, count(*) AS n FROM named GROUP BY ALL), h AS (SELECT s, string_agg(symbol, ' ' ORDER BY symbol) AS names, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY symbol) AS ns FROM k GROUP BY s) SELECT s, 'structure' || chr(10) || '1.0' || chr(10) || '8.0 0.0 0.0' || chr(10) || '0.0 9.0 0.0' || chr(10) || '0.0 0.0 10.0' || chr(10) || any_value(names) || chr(10) || any_value(ns) || chr(10) || 'Cartesian' || chr(10) || string_agg(printf('%.6f %.6f %.6f', x, y, z), chr(10) ORDER BY symbol, atom_id) AS text FROM named JOIN h USING (s) GROUP BY s")
def _(t: Tables) -> DataFrame:
    return W.poscar_text(_named(t), ["s"], (8.0, 9.0, 10.0))


_CARDS = "EDGE      K\nS02       1.0\nEXCHANGE  0\nCONTROL   1 1 1 1 1 1\nPRINT     1 0 0 0 0 3\nEXAFS     20\nNLEG      6\nRPATH     0.4\n\nPOTENTIALS\n"


@query("e2_k3_solver_inputs", f"""{NAMED}, o AS (SELECT * FROM named QUALIFY symbol = 'Ag' AND row_number() OVER (PARTITION BY s, symbol ORDER BY atom_id) = 1),
  near AS (SELECT * FROM (SELECT a.s, a.atom_id, a.symbol, a.x - o.x AS x, a.y - o.y AS y, a.z - o.z AS z, sqrt((a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) + (a.z - o.z) * (a.z - o.z)) AS dist FROM named a JOIN o ON a.s = o.s) WHERE dist <= 0.4e0),
  kinds AS (SELECT s, list_sort(list(DISTINCT symbol)) AS kinds FROM near WHERE dist > 0 GROUP BY s),
  placed AS (SELECT near.*, CASE symbol WHEN 'Ag' THEN 47 ELSE 79 END AS number, CASE WHEN dist = 0 THEN 0 ELSE list_position(kinds, symbol) END AS ipot FROM near LEFT JOIN kinds USING (s)),
  pots AS (SELECT s, string_agg(printf('%6d%6d    %s', ipot, number, symbol), chr(10) ORDER BY ipot) AS pots FROM (SELECT DISTINCT s, ipot, number, symbol FROM placed) GROUP BY s)
  SELECT s, '{_CARDS}' || any_value(pots) || chr(10) || chr(10) || 'ATOMS' || chr(10) || string_agg(printf('%10.5f%10.5f%10.5f%4d  %-4s%10.5f', x, y, z, ipot, symbol, dist), chr(10) ORDER BY dist, atom_id) || chr(10) || 'END' || chr(10) AS text FROM placed JOIN pots USING (s) GROUP BY s""")
def _(t: Tables) -> DataFrame:
    return solver_inputs(_named(t), "Ag", SpectrumConfig(radius=0.4), ["s"])
