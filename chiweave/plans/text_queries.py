"""Queries over text: parsers of the line formats (on lines made from the tables, so
the oracle is the table itself), cards, keys, names, maps and casts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SpectrumConfig
from ..functions import keys
from ..functions import text as T
from ..operators import cards as C
from ..operators import spectra as X
from ..sources import structures
from ..sources import text as R
from .registry import MEAN, Tables, query, r6

L = F.lit


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _stack(t: Tables, df: DataFrame, file: str, *line: Column) -> DataFrame:
    """Lines of a file each, in the order given."""
    return df.select(F.col(file).cast("string").alias("file"), F.posexplode(F.array(*line)).alias("line_no", "line"))


@query("s4_first_frame_types", "SELECT CAST(l_orderkey AS VARCHAR) AS file, l_partkey AS atom_id, l_linenumber AS type FROM lineitem")
def _(t: Tables) -> DataFrame:
    head = t.orders.select(_s("o_orderkey").alias("file"), F.posexplode(F.array(L("ITEM: TIMESTEP"), L("0"), L("ITEM: ATOMS xs id type"))).alias("line_no", "line"))
    line = F.concat_ws(" ", L("0.5"), _s("l_partkey"), _s("l_linenumber"))
    body = t.lineitem.select(_s("l_orderkey").alias("file"), (F.col("l_linenumber") + 10).alias("line_no"), line.alias("line"))
    tail = t.orders.select(_s("o_orderkey").alias("file"), F.posexplode(F.array(L("ITEM: TIMESTEP"), L("1"), L("ITEM: ATOMS id type"), L("7 7"))).alias("n", "line")).select("file", (F.col("n") + 1000).alias("line_no"), "line")
    return R.first_frame_types(head.unionByName(body).unionByName(tail))


@query("s5_pair_species", "SELECT CAST(p_partkey AS VARCHAR) AS file, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part")
def _(t: Tables) -> DataFrame:
    rows = _stack(t, t.part, "p_partkey", L("# deck"), F.concat(L("pair_coeff * *  model.json "), F.col("p_name")), L("pair_coeff * * other.json X Y"))
    return R.pair_species(rows).select("file", F.get("species", L(0)).alias("a"), F.get("species", L(1)).alias("b"))


@query("s6_p8_run_info", "SELECT CAST(o_orderkey AS VARCHAR) AS file, o_totalprice AS temp, 0.002e0 AS timestep, o_custkey AS nsteps, o_orderstatus AS pair_style, round(o_custkey * 0.002e0, 6) AS averaging_time FROM orders")
def _(t: Tables) -> DataFrame:
    rows = _stack(t, t.orders, "o_orderkey", L("variable TEMP equal 1"), F.concat(L("variable TEMP equal "), _s("o_totalprice")), L("timestep 0.002"), F.concat(L("variable NUMMDSTEPS equal "), _s("o_custkey")), F.concat(L("pair_style "), F.col("o_orderstatus")), L("run 0"))
    return R.run_info(rows).select("file", "temp", "timestep", "nsteps", "pair_style", r6("averaging_time").alias("averaging_time"))


def _rdf_lines(t: Tables) -> DataFrame:
    row = F.concat_ws(" ", _s("l_linenumber"), _s("l_quantity"), _s("l_discount"), L("1"), L("0"), L("2"), _s("l_tax"), L("3"), L("5e-1"), L("4"))
    body = t.lineitem.select(_s("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"), row.alias("line"))
    rest = _stack(t, t.orders, "o_orderkey", L("# comment 1 2 3 4 5 6 7 8 9"), L("2000 100"), L("1 2 3 4 5 6 7 8 9 x"), L("")).withColumn("line_no", -F.col("line_no") - 1)
    return body.unionByName(rest)


@query("s7_p7_rdf_table", "SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS bin, l_quantity AS r, l_discount AS g11, 1.0e0 AS cn11, 0.0e0 AS g12, 2.0e0 AS cn12, l_tax AS g21, 3.0e0 AS cn21, 0.5e0 AS g22, 4.0e0 AS cn22 FROM lineitem")
def _(t: Tables) -> DataFrame:
    return R.rdf(_rdf_lines(t))


@query("f8_positive_rdf_series", "SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS bin, l_quantity AS r, series, g, cn FROM (SELECT *, '11' AS series, l_discount AS g, 1.0e0 AS cn FROM lineitem UNION ALL SELECT *, '12', 0.0e0, 2.0e0 FROM lineitem UNION ALL SELECT *, '21', l_tax, 3.0e0 FROM lineitem UNION ALL SELECT *, '22', 0.5e0, 4.0e0 FROM lineitem) WHERE g > 0")
def _(t: Tables) -> DataFrame:
    return R.rdf_long(R.rdf(_rdf_lines(t)))


_MSD = "msd AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, max(l_linenumber)::BIGINT AS timestep, arg_max(l_discount, n) AS msd_all, arg_max(l_tax, n) AS msd_ag, 0.03e0 AS msd_au FROM (SELECT *, l_linenumber * 1000000000000000 + l_partkey * 100000 + CAST(round(l_discount * 100) AS BIGINT) * 100 + CAST(round(l_tax * 100) AS BIGINT) AS n FROM lineitem) GROUP BY l_orderkey)"


def _msd(t: Tables) -> DataFrame:
    line = F.concat_ws(" ", _s("l_linenumber"), _s("l_discount"), _s("l_tax"), L("0.03"))
    number = F.expr("l_linenumber * 1000000000000000 + l_partkey * 100000 + CAST(round(l_discount * 100) AS BIGINT) * 100 + CAST(round(l_tax * 100) AS BIGINT)")
    rows = t.lineitem.select(_s("l_orderkey").alias("file"), number.alias("line_no"), line.alias("line"))
    notes = t.orders.select(_s("o_orderkey").alias("file"), L(1 << 60).alias("line_no"), L("# end").alias("line"))
    return R.msd(rows.unionByName(notes), 0.05)


@query("s8_l5_msd_last_line", f"WITH {_MSD} SELECT file, timestep, msd_all, msd_ag FROM msd")
def _(t: Tables) -> DataFrame:
    return _msd(t).select("file", "timestep", "msd_all", "msd_ag")


@query("a9_f9_largest_displacement", f"WITH {_MSD} SELECT file, greatest(msd_all, msd_ag, msd_au) AS largest, CASE greatest(msd_all, msd_ag, msd_au) WHEN msd_au THEN 'au' WHEN msd_all THEN 'all' ELSE 'ag' END AS species, greatest(msd_all, msd_ag, msd_au) > 0.05e0 AS drifting FROM msd")
def _(t: Tables) -> DataFrame:
    return _msd(t).select("file", "largest", "species", "drifting")


_NAMES = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'feff' || lpad(CAST(doc_id AS VARCHAR), 4, '0') || '.dat' WHEN 1 THEN 'FEFF' || doc_id || '.DAT' WHEN 2 THEN 'log' || doc_id || '.dat' WHEN 3 THEN 'misc.dat' ELSE 'chi.dat' END AS name FROM documents"


def _names(t: Tables) -> DataFrame:
    d, s = F.col("doc_id") % 5, _s("doc_id")
    name = F.when(d == 0, F.concat(L("feff"), F.when(F.length(s) >= 4, F.substring(s, 1, 4)).otherwise(F.lpad(s, 4, "0")), L(".dat"))).when(d == 1, F.concat(L("FEFF"), s, L(".DAT"))).when(d == 2, F.concat(L("log"), s, L(".dat"))).when(d == 3, L("misc.dat")).otherwise(L("chi.dat"))
    return t.documents.select("doc_id", name.alias("name"))


@query("s11_x7_numbered_files", f"SELECT doc_id, name FROM ({_NAMES}) WHERE regexp_full_match(lower(name), 'feff[0-9]+[.]dat')")
def _(t: Tables) -> DataFrame:
    return R.numbered_files(_names(t))


@query("k14_files_to_remove", f"SELECT name LIKE '%.dat' AS lower, count(*) FILTER (regexp_matches(lower(name), '^feff[0-9]+[.]dat$') OR regexp_matches(name, '^(feffrun_.*[.]log|log.*[.]dat|misc[.]dat)$')) AS removed, count(*) AS files FROM ({_NAMES}) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _names(t).groupBy(F.col("name").endswith(".dat").alias("lower")).agg(F.count_if(T.is_removable(F.col("name"))).alias("removed"), F.count("*").alias("files"))


@query("u4_l7_output_listing", f"SELECT name, count(*) AS n FROM ({_NAMES}) WHERE name NOT IN ('misc.dat', 'feff.inp') GROUP BY name")
def _(t: Tables) -> DataFrame:
    return _names(t).filter(~F.col("name").isin("misc.dat", "feff.inp")).groupBy("name").agg(F.count("*").alias("n")).orderBy("name")


@query("s18_options_from_text", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.options(F.col("props"), "k long")["k"].alias("k"))


def _cards(t: Tables) -> DataFrame:
    return _stack(t, t.part, "p_partkey", L("TITLE one"), F.concat(L("EDGE      "), F.substring("p_type", 1, 2)), L("S02       1.0"), L("SCFX      9"), L("RPATH     8.00"), L("END"))


@query("x4_x5_x6_cards_rewritten", """SELECT CAST(p_partkey AS VARCHAR) AS file, 'TITLE one' || chr(10) || 'EDGE      ' || substr(p_type, 1, 2) || chr(10) || 'NLEG      6' || chr(10) || 'SCF       5.0' || chr(10) || 'S02       0.9' || chr(10) || 'SCFX      9' || chr(10) || 'RPATH     6.0' || chr(10) || 'END' AS text FROM part""")
def _(t: Tables) -> DataFrame:
    return C.joined(C.rewritten(_cards(t), {"S02": "0.9", "SCF": "5.0", "NLEG": "6", "RPATH": "6.0"}))


@query("a13_x2_x3_card_tags", "SELECT CAST(p_partkey AS VARCHAR) AS file, 'EDGE,END,RPATH,S02,SCFX,TITLE' AS tags FROM part")
def _(t: Tables) -> DataFrame:
    return R.feff_cards(_cards(t)).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("u2_missing_tags", "SELECT p_partkey, array_to_string(list_filter(['S02', 'SCF', 'NLEG'], lambda x: NOT list_contains(['TITLE', 'S02', CASE WHEN p_size > 25 THEN 'SCF' ELSE '-' END], x)), ',') AS missing FROM part")
def _(t: Tables) -> DataFrame:
    present = F.array(L("TITLE"), L("S02"), F.when(F.col("p_size") > 25, "SCF").otherwise("-"))
    wanted = F.map_keys(F.create_map(*(L(x) for k in ("S02", "SCF", "NLEG") for x in (k, ""))))
    return t.part.select("p_partkey", F.array_join(F.array_except(wanted, present), ",").alias("missing"))


@query("u5_x20_merged_settings", "SELECT p_partkey, '1.0' AS s02, CASE WHEN p_size > 25 THEN p_brand ELSE '5.0' END AS scf, CAST(p_size AS VARCHAR) AS rpath, CAST(NULL AS VARCHAR) AS corehole, CAST(8 AS INTEGER) AS n FROM part")
def _(t: Tables) -> DataFrame:
    defaults = F.create_map(*(L(x) for kv in C.DEFAULTS.items() for x in kv))
    given = F.when(F.col("p_size") > 25, F.create_map(L("SCF"), F.col("p_brand"), L("COREHOLE"), L("2"))).otherwise(F.create_map(L("COREHOLE"), L("2")))
    m = t.part.select("p_partkey", C.merged(defaults, given, _s("p_size")).alias("m"))
    at = lambda k: F.try_element_at("m", L(k))
    return m.select("p_partkey", at("S02").alias("s02"), at("SCF").alias("scf"), at("RPATH").alias("rpath"), at("COREHOLE").alias("corehole"), F.size("m").alias("n"))


@query("p6_settings_without_nulls", "SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS INTEGER) AS n FROM part")
def _(t: Tables) -> DataFrame:
    m = F.create_map(L("kmin"), L(2.0), L("dk2"), F.when(F.col("p_size") > 25, F.col("p_retailprice")))
    return t.part.select("p_partkey", F.size(C.without_nulls(m)).alias("n"))


@query("x1_capitalised_symbols", "SELECT p_partkey, upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2) AS symbol FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.symbol(F.col("p_type")).alias("symbol"))


@query("x2_tokens", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS INTEGER) AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))


@query("x8_l6_padded_names", "SELECT doc_id, 'frame_' || CASE WHEN doc_id < 10000 THEN lpad(CAST(doc_id AS VARCHAR), 4, '0') ELSE CAST(doc_id AS VARCHAR) END AS frame, 'struct_f' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.cif' AS structure FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.frame_name(F.col("doc_id")).alias("frame"), T.structure_name(F.col("doc_id")).alias("structure"))


_CONFIG = SpectrumConfig(radius=6.0)


def _config_md5() -> str:
    import hashlib
    import json

    return hashlib.md5(json.dumps(_CONFIG.chi_settings(), sort_keys=True).encode()).hexdigest()[:16]


@query("x9_x10_cache_keys", f"SELECT l_orderkey, substr(md5(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey)), 1, 16) || '_Fe_{_config_md5()}' AS cache_key FROM lineitem GROUP BY l_orderkey")
def _(t: Tables) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    key = keys.cache_key(keys.structure_hash(parts), L("Fe"), keys.config_hash(_CONFIG))
    return t.lineitem.groupBy("l_orderkey").agg(key.alias("cache_key"))


@query("x21_settings_as_json", "SELECT p_partkey, '{\"size\":' || p_size || ',\"type\":\"' || p_type || '\"}' AS json FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("type"))).alias("json"))


@query("x22_numbers_or_null", "SELECT p_partkey, TRY_CAST(CASE WHEN p_size > 25 THEN CAST(p_retailprice AS VARCHAR) ELSE p_name END AS DOUBLE) AS v FROM part")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_size") > 25, _s("p_retailprice")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", F.get(T.numbers(F.regexp_replace(raw, " ", "_")), L(0)).alias("v"))


_SAVED = f"{MEAN}, saved AS (SELECT traj_id, k_idx, k, chi FROM mean)"


@query("k2_k9_saved_average", f"{_SAVED} SELECT traj_id, '# k chi_mean' || chr(10) || string_agg(printf('%.6f %.6f', k, chi), chr(10) ORDER BY k_idx) AS text FROM saved GROUP BY traj_id")
def _(t: Tables) -> DataFrame:
    return R.two_columns(X.average(t.spectra()), "k", "chi", "k chi_mean", ["traj_id"])


def _folder(t: Tables) -> str:
    """A folder for files that a query writes and reads back: shared where the cluster
    names one."""
    root = t.spark.conf.get("spark.checkpoint.dir", None)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="chiweave-")


@query("s9_s10_k1_chi_files", f"{_SAVED} SELECT traj_id AS frame_idx, k_idx, round(k, 6) + 0.0 AS k, round(chi, 6) + 0.0 AS chi FROM saved")
def _(t: Tables) -> DataFrame:
    at = _folder(t)
    made = R.two_columns(X.average(t.spectra()), "k", "chi", "k chi", ["traj_id"])
    structures.write_texts(made, at, F.concat(T.frame_name(F.col("traj_id")), L("/chi.dat")))
    back = R.frame_spectra(t.spark, at).select(F.col("frame_idx").cast("int"), F.posexplode(F.arrays_zip("k", "chi")).alias("k_idx", "p"))
    return back.select("frame_idx", "k_idx", r6("p.k").alias("k"), r6("p.chi").alias("chi"))


@query("s3_dump_frames", "SELECT CAST(s_nationkey AS BIGINT) AS timestep, CAST(s_suppkey AS BIGINT) AS atom_id, CAST(s_suppkey % 2 + 1 AS INTEGER) AS type, s_acctbal AS xs, 0.25e0 AS zs FROM supplier")
def _(t: Tables) -> DataFrame:
    line = F.concat_ws(" ", _s("s_suppkey"), (F.col("s_suppkey") % 2 + 1).cast("string"), _s("s_acctbal"), L("0.5 0.25 0 0 0"))
    frame = F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line"))))
    head = F.concat(L("ITEM: TIMESTEP\n"), _s("s_nationkey"), L("\nITEM: NUMBER OF ATOMS\n"), F.col("n").cast("string"), L("\nITEM: ATOMS id type xs ys zs fx fy fz\n"))
    frames = t.supplier.groupBy("s_nationkey").agg(frame.alias("a"), F.count("*").alias("n")).select("s_nationkey", F.concat(head, F.concat_ws("\n", F.transform("a", lambda r: r["line"]))).alias("text"))
    at = _folder(t)
    structures.write_texts(frames, at, F.format_string("part%04d.dump", "s_nationkey"))
    return R.lammps_dump(t.spark, f"{at}/*.dump").select("timestep", "atom_id", "type", "xs", "zs")


@query("e3_e4_method_settings", "SELECT * FROM (VALUES ('auto', 'CONTROL,EXAFS,EXCHANGE,NLEG,PRINT,RPATH,S02', '7'), ('larixite', 'CONTROL,EXAFS,EXCHANGE,NLEG,PRINT,RPATH,S02', '7'), ('pymatgen', 'CONTROL,EXAFS,EXCHANGE,NLEG,PRINT,RPATH,S02,SCF', '7')) AS v(method, tags, rpath)")
def _(t: Tables) -> DataFrame:
    from .inputs import settings

    rows = []
    for method in ("auto", "larixite", "pymatgen"):
        cards = settings(SpectrumConfig(method=method, radius=7.0, user_tag_settings={"COREHOLE": "FSR"}))
        rows.append((method, ",".join(sorted(cards)), cards["RPATH"]))
    return t.spark.createDataFrame(rows, "method string, tags string, rpath string")


@query("e1_runner_with_failures", "SELECT CAST(p_brand AS VARCHAR) AS traj_id, p_partkey AS frame_idx, CASE WHEN p_size > 40 THEN 'ValueError: too large' END AS error, CASE WHEN p_size <= 40 THEN p_size * 0.5e0 END AS chi1 FROM part")
def _(t: Tables) -> DataFrame:
    from .pipeline import run_frames

    def runner(body: str, absorber: str, config: SpectrumConfig) -> tuple[list[float], list[float]]:
        if int(body) > 40:
            raise ValueError("too large")
        return [0.0, 0.05], [0.0, int(body) * 0.5]

    rows = t.part.select(F.col("p_brand").alias("traj_id"), F.col("p_partkey").alias("frame_idx"), L("").alias("cache_key"), _s("p_size").alias("structure"))
    return run_frames(rows, "Fe", _CONFIG, runner).select("traj_id", "frame_idx", "error", F.get("chi", L(1)).alias("chi1"))
