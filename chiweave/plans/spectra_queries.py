"""Queries over spectra: sampling, weighting, alignment, averages, transform, sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SpectrumConfig
from ..functions import numeric as N
from ..operators import sampling as S
from ..operators import spectra as X
from .registry import MEAN, SPECTRA, Tables, query, r6

FT = SpectrumConfig(kmin=0.5, kmax=2.5, dk=0.5, kweight=2)


def _window_sql(shape: str, c: SpectrumConfig = FT) -> str:
    dk2 = c.dk if c.dk2 is None else c.dk2
    if shape == "gaussian":
        mid = (c.kmin + c.kmax) / 2
        return f"exp(-((k - {mid}e0) * (k - {mid}e0)) / {2 * c.dk * c.dk}e0)"
    x1, x2, x3, x4 = c.kmin - c.dk / 2, c.kmin + c.dk / 2, c.kmax - dk2 / 2, c.kmax + dk2 / 2
    form = {"hanning": "pow(sin(({t}) * pi() / 2), 2)", "parzen": "({t})", "welch": "(1.0e0 - (1.0e0 - ({t})) * (1.0e0 - ({t})))", "sine": "sin(({t}) * pi() / 2)"}[shape]
    rise, fall = form.format(t=f"(k - {x1}e0) / {x2 - x1}e0"), form.format(t=f"({x4}e0 - k) / {x4 - x3}e0")
    return f"CASE WHEN k < {x1}e0 OR k > {x4}e0 THEN 0.0e0 WHEN k < {x2}e0 THEN {rise} WHEN k > {x3}e0 THEN {fall} ELSE 1.0e0 END"


def _ft_sql(source: str, by: str) -> str:
    return f"""basis AS (SELECT CAST(n AS INTEGER) AS n, CAST(m AS INTEGER) AS m, cos(((n * m) % 2048) * (2 * pi() / 2048)) AS c, sin(((n * m) % 2048) * (2 * pi() / 2048)) AS s
        FROM (SELECT unnest(range(64)) AS n), (SELECT unnest(range({X.n_radii(FT)})) AS m)),
      x AS (SELECT {by}, k_idx, chi * k * k * ({_window_sql('hanning')}) AS x FROM {source}),
      ft AS (SELECT {by}, m, sum(x * c) * {0.05 / math.sqrt(math.pi)!r}e0 AS re, -sum(x * s) * {0.05 / math.sqrt(math.pi)!r}e0 AS im FROM x JOIN basis ON k_idx = n WHERE x <> 0 GROUP BY {by}, m)
      SELECT {by}, m, round(m * {math.pi / (0.05 * 2048)!r}e0, 6) + 0.0 AS r, round(re, 6) + 0.0 AS chir_re, round(im, 6) + 0.0 AS chir_im, round(sqrt(re * re + im * im), 6) + 0.0 AS chir_mag FROM ft"""


@query("f1_every_nth_frame", f"WITH {SPECTRA} SELECT traj_id, frame_idx, k_idx, chi FROM spectra WHERE frame_idx % 7 = 0")
def _(t: Tables) -> DataFrame:
    return S.every_nth(t.spectra(), 7).select("traj_id", "frame_idx", "k_idx", "chi")


@query("f2_last_frame", f"WITH {SPECTRA} SELECT traj_id, frame_idx, k_idx, round(chi, 6) + 0.0 AS chi FROM spectra JOIN (SELECT label AS traj_id, max(vec_id) AS frame_idx FROM embeddings GROUP BY label) USING (traj_id, frame_idx)")
def _(t: Tables) -> DataFrame:
    return S.frame_at(t.spectra(), -1, ["traj_id"]).select("traj_id", "frame_idx", "k_idx", r6("chi").alias("chi"))


@query("f2_third_from_end", "SELECT conv_id, turn, role FROM conversations QUALIFY dense_rank() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 3")
def _(t: Tables) -> DataFrame:
    return S.frame_at(t.conversations, -3, ["conv_id"], "turn").select("conv_id", "turn", "role")


@query("f3_start_stride_limit", "SELECT vec_id AS frame_idx, label AS traj_id FROM embeddings WHERE vec_id >= 10 AND (vec_id - 10) % 5 = 0 ORDER BY vec_id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return S.window_slice(t.arrays(), 10, 5, 20).select("frame_idx", "traj_id")


_ERRORS = "CASE WHEN toxic = 1 THEN 'failed' END AS error, CASE WHEN quality = 1 THEN n_chars END AS k"


def _flagged(t: Tables) -> DataFrame:
    both = t.documents.join(t.labels, "doc_id")
    return both.select(F.col("doc_id").alias("frame_idx"), F.when(F.col("toxic") == 1, "failed").alias("error"), F.when(F.col("quality") == 1, F.col("n_chars")).alias("k"), F.col("n_chars").alias("chi"))


@query("f4_drop_failed", f"SELECT frame_idx, chi FROM (SELECT doc_id AS frame_idx, n_chars AS chi, {_ERRORS} FROM documents JOIN labels USING (doc_id)) WHERE error IS NULL")
def _(t: Tables) -> DataFrame:
    return _flagged(t).filter("error IS NULL").select("frame_idx", "chi")


@query("f5_drop_null_spectra", f"SELECT frame_idx, chi FROM (SELECT doc_id AS frame_idx, n_chars AS chi, {_ERRORS} FROM documents JOIN labels USING (doc_id)) WHERE error IS NULL AND k IS NOT NULL AND chi IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return S.successful(_flagged(t)).select("frame_idx", "chi")


@query("f6_frames_without_output", "SELECT doc_id AS frame_idx FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def _(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select(F.col("doc_id").alias("frame_idx"))


@query("f7_drop_leading_zero", f"WITH {SPECTRA} SELECT traj_id, frame_idx, k_idx, k, chi FROM spectra WHERE NOT (k_idx = 0 AND abs(k) < 1e-12)")
def _(t: Tables) -> DataFrame:
    return S.without_leading_zero(t.spectra()).select("traj_id", "frame_idx", "k_idx", "k", "chi")


@query("f13_equal_grid", "SELECT e.label AS traj_id, e.vec_id AS frame_idx, e.embedding = r.ref AS same FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label) r ON e.label = r.label")
def _(t: Tables) -> DataFrame:
    e = t.embeddings
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return e.join(ref, "label").select(F.col("label").alias("traj_id"), F.col("vec_id").alias("frame_idx"), N.same_grid(F.col("embedding"), F.col("ref")).alias("same"))


@query("f14_compatible_grid", "SELECT e.label AS traj_id, e.vec_id AS frame_idx, len(list_filter(range(1, 65), lambda i: abs(CAST(e.embedding[i] AS DOUBLE) - CAST(r.ref[i] AS DOUBLE)) > 0.7e0)) = 0 AS compatible FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label) r ON e.label = r.label")
def _(t: Tables) -> DataFrame:
    e = t.arrays()
    ref = e.groupBy("traj_id").agg(F.min_by("chi", "frame_idx").alias("ref"))
    return e.join(ref, "traj_id").select("traj_id", "frame_idx", N.compatible_grid(F.col("chi"), F.col("ref"), 0.7).alias("compatible"))


@query("f17_run_success", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND o_orderstatus = 'F' AS ok FROM orders")
def _(t: Tables) -> DataFrame:
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("there", F.lit(True))
    return t.orders.join(done, "o_orderkey", "left").select("o_orderkey", (F.coalesce("there", F.lit(False)) & (F.col("o_orderstatus") == "F")).alias("ok"))


@query("f18_sampling_choice", "SELECT 'all' AS mode, count(*) AS n FROM embeddings UNION ALL SELECT 'single', count(*) FROM embeddings WHERE vec_id = 3 UNION ALL SELECT 'every', count(*) FROM embeddings WHERE vec_id % 4 = 0")
def _(t: Tables) -> DataFrame:
    parts = [S.choose(t.arrays(), m, v).select(F.lit(m).alias("mode")) for m, v in (("all", 1), ("single", 3), ("every", 4))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("mode").agg(F.count("*").alias("n"))


@query("p1_k_weighting", f"WITH {SPECTRA} SELECT traj_id, frame_idx, k_idx, round(chi, 6) + 0.0 AS chi, round(chi * pow(k, 2), 6) + 0.0 AS k2chi, round(chi * pow(k, 3), 6) + 0.0 AS k3chi FROM spectra")
def _(t: Tables) -> DataFrame:
    w = lambda n: r6(N.k_weighted(F.col("chi"), F.col("k"), n))
    return t.spectra().select("traj_id", "frame_idx", "k_idx", w(0).alias("chi"), w(2).alias("k2chi"), w(3).alias("k3chi"))


@query("p2_p3_weighted_envelope", f"{MEAN} SELECT traj_id, k_idx, round(chi * k * k, 6) + 0.0 AS chi_w, round(chi_std * k * k, 6) + 0.0 AS std_w, round(chi * k * k - chi_std * k * k, 6) + 0.0 AS low, round(chi * k * k + chi_std * k * k, 6) + 0.0 AS high FROM mean")
def _(t: Tables) -> DataFrame:
    return X.envelope(X.average(t.spectra()), 2).select("traj_id", "k_idx", *(r6(c).alias(c) for c in ("chi_w", "std_w", "low", "high")))


@query("p10_cache_hit_rate", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) FILTER (o_orderstatus <> 'F') AS misses, round(CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) * 100.0e0 END, 6) AS rate FROM orders GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count_if(F.col("o_orderstatus") != "F").alias("misses"))
    return g.withColumn("rate", F.round(N.hit_rate(F.col("hits"), F.col("misses")), 6))


_KNOTS = "knots AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS x, avg(value) AS y FROM events GROUP BY ALL), bounds AS (SELECT floor(min(x)) AS x0, floor(max(x)) AS x1 FROM knots), grid AS (SELECT u.user_id, x0 + i * 3600.0e0 AS x FROM (SELECT DISTINCT user_id FROM events) u, bounds, (SELECT unnest(range(CAST(floor((x1 - x0) / 3600) AS BIGINT) + 1)) AS i FROM bounds))"


@query(
    "j1_resample",
    f"""WITH {_KNOTS}, a AS (SELECT g.user_id, g.x, k.x AS xa, k.y AS ya FROM grid g ASOF LEFT JOIN knots k ON g.user_id = k.user_id AND g.x >= k.x),
      b AS (SELECT g.user_id, g.x, k.x AS xb, k.y AS yb FROM grid g ASOF LEFT JOIN knots k ON g.user_id = k.user_id AND g.x <= k.x)
      SELECT user_id, x, round(CASE WHEN xa IS NULL OR xb IS NULL THEN 0.0e0 WHEN xa = xb THEN ya ELSE ya + (yb - ya) * (x - xa) / (xb - xa) END, 6) + 0.0 AS y FROM a JOIN b USING (user_id, x)""",
)
def _(t: Tables) -> DataFrame:
    x = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    e = t.events.select("user_id", x.alias("x"), F.col("value").alias("y"))
    span = e.agg(F.floor(F.min("x")).cast("double").alias("x0"), F.floor(F.max("x")).cast("double").alias("x1"))  # one row
    hours = F.floor((F.col("x1") - F.col("x0")) / 3600.0).cast("int")
    points = span.select(F.transform(F.sequence(F.lit(0), hours), lambda i: F.col("x0") + i * F.lit(3600.0)).alias("xs"))
    grid = e.select("user_id").distinct().join(F.broadcast(points)).select("user_id", F.explode("xs").alias("x"))  # one row of the span's hours
    return X.interpolate(e, grid, ["user_id"]).select("user_id", "x", r6("y").alias("y"))


#: Frames on grids of their own: k = i * step, the step set by the frame's number.
_OWN = "own AS (SELECT label AS traj_id, vec_id AS frame_idx, i AS k_idx, CAST(i AS DOUBLE) * (0.04e0 + (vec_id % 3) * 0.01e0) AS k, CAST(embedding[i + 1] AS DOUBLE) AS chi FROM embeddings, (SELECT CAST(unnest(range(64)) AS INTEGER) AS i))"


def _own(t: Tables) -> DataFrame:
    step = F.lit(0.04) + (F.col("vec_id") % 3) * F.lit(0.01)
    k = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("double") * step)
    return t.embeddings.select(F.col("label").alias("traj_id"), F.col("vec_id").alias("frame_idx"), k.alias("k"), F.col("embedding").cast("array<double>").alias("chi"))


@query("j2_reference_grid", f"WITH {_OWN} SELECT traj_id, k_idx, round(k, 6) + 0.0 AS k FROM own JOIN (SELECT label AS traj_id, min(vec_id) AS frame_idx FROM embeddings GROUP BY label) USING (traj_id, frame_idx)")
def _(t: Tables) -> DataFrame:
    return X.reference_grid(_own(t)).select("traj_id", F.posexplode("k_ref").alias("k_idx", "k")).select("traj_id", "k_idx", r6("k").alias("k"))


@query(
    "j2_j1_aligned_to_reference",
    f"""WITH {_OWN}, ref AS (SELECT label AS traj_id, min(vec_id) AS first FROM embeddings GROUP BY label),
      g AS (SELECT f.traj_id, f.frame_idx, r.k_idx, r.k AS x FROM (SELECT DISTINCT traj_id, frame_idx FROM own) f JOIN ref USING (traj_id) JOIN own r ON r.traj_id = f.traj_id AND r.frame_idx = ref.first),
      a AS (SELECT g.*, k.k AS xa, k.chi AS ya FROM g ASOF LEFT JOIN own k ON g.traj_id = k.traj_id AND g.frame_idx = k.frame_idx AND g.x >= k.k),
      b AS (SELECT g.*, k.k AS xb, k.chi AS yb FROM g ASOF LEFT JOIN own k ON g.traj_id = k.traj_id AND g.frame_idx = k.frame_idx AND g.x <= k.k)
      SELECT traj_id, frame_idx, k_idx, round(CASE WHEN xa IS NULL OR xb IS NULL THEN 0.0e0 WHEN xa = xb THEN ya ELSE ya + (yb - ya) * (x - xa) / (xb - xa) END, 6) + 0.0 AS chi FROM a JOIN b USING (traj_id, frame_idx, k_idx, x)""",
)
def _(t: Tables) -> DataFrame:
    return X.aligned(_own(t)).select("traj_id", "frame_idx", "k_idx", r6("chi").alias("chi"))


@query("a1_mean_spectrum", f"{MEAN} SELECT traj_id, k_idx, k, round(chi, 6) + 0.0 AS chi FROM mean")
def _(t: Tables) -> DataFrame:
    return X.average(t.spectra()).select("traj_id", "k_idx", "k", r6("chi").alias("chi"))


@query("a2_a3_spread_and_count", f"{MEAN} SELECT traj_id, k_idx, round(chi_std, 6) + 0.0 AS chi_std, nframes FROM mean")
def _(t: Tables) -> DataFrame:
    return X.average(t.spectra()).select("traj_id", "k_idx", r6("chi_std").alias("chi_std"), "nframes")


@query("a6_fourier_of_mean", f"{MEAN}, {_ft_sql('mean', 'traj_id')}")
def _(t: Tables) -> DataFrame:
    return X.fourier(X.average(t.spectra()), FT, 64).select("traj_id", "m", *(r6(c).alias(c) for c in ("r", "chir_re", "chir_im", "chir_mag")))


@query("a6_fourier_per_frame", f"WITH {SPECTRA}, {_ft_sql('spectra', 'traj_id, frame_idx')}")
def _(t: Tables) -> DataFrame:
    return X.fourier_frames(t.arrays(), FT).select("traj_id", "frame_idx", "m", *(r6(c).alias(c) for c in ("r", "chir_re", "chir_im", "chir_mag")))


@query(
    "a6_fourier_of_shifted_grid",
    f"""WITH mean0 AS (SELECT label AS traj_id, i, 0.3e0 + CAST(i AS DOUBLE) * 0.06e0 AS k, avg(CAST(embedding[i + 1] AS DOUBLE)) AS chi FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY ALL),
      g AS (SELECT traj_id, CAST(n AS INTEGER) AS k_idx, n * 0.05e0 AS x FROM (SELECT DISTINCT traj_id FROM mean0), (SELECT unnest(range(82)) AS n)),
      a AS (SELECT g.*, m.k AS xa, m.chi AS ya FROM g ASOF LEFT JOIN mean0 m ON g.traj_id = m.traj_id AND g.x >= m.k),
      b AS (SELECT g.*, m.k AS xb, m.chi AS yb FROM g ASOF LEFT JOIN mean0 m ON g.traj_id = m.traj_id AND g.x <= m.k),
      mean AS (SELECT traj_id, k_idx, x AS k, CASE WHEN xa IS NULL OR xb IS NULL THEN 0.0e0 WHEN xa = xb THEN ya ELSE ya + (yb - ya) * (x - xa) / (xb - xa) END AS chi FROM a JOIN b USING (traj_id, k_idx, x)),
      {_ft_sql('mean', 'traj_id').replace('range(64)', 'range(82)')}""",
)
def _(t: Tables) -> DataFrame:
    moved = X.average(t.spectra().withColumn("k", F.lit(0.3) + F.col("k_idx") * F.lit(0.06)))
    straight, n = X.on_grid(moved, 0.05)
    return X.fourier(straight, FT, n).select("traj_id", "m", *(r6(c).alias(c) for c in ("r", "chir_re", "chir_im", "chir_mag")))


@query("a11_cache_counters", "SELECT count(*) FILTER (l.l_orderkey IS NOT NULL) AS hits, count(*) FILTER (l.l_orderkey IS NULL) AS misses FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25) l ON l.l_orderkey = o_orderkey")
def _(t: Tables) -> DataFrame:
    from ..operators.cache import counters

    held = t.lineitem.filter("l_quantity > 25").select(F.col("l_orderkey").alias("cache_key"))
    return counters(t.orders.select(F.col("o_orderkey").alias("cache_key")), held).select("hits", "misses")


@query("j4_s15_cache_hits_and_misses", "SELECT 'hit' AS kind, o_orderkey AS cache_key FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) UNION ALL SELECT 'miss', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def _(t: Tables) -> DataFrame:
    from ..operators.cache import split

    held = t.lineitem.filter("l_quantity > 25").select(F.col("l_orderkey").alias("cache_key"))
    hits, misses = split(t.orders.select(F.col("o_orderkey").alias("cache_key")), held)
    return hits.select(F.lit("hit").alias("kind"), "cache_key").unionByName(misses.select(F.lit("miss").alias("kind"), "cache_key"))


@query("a10_p9_cache_size", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, round(CAST(sum(n_chars) AS DOUBLE) / 1048576.0e0, 2) AS size_mb FROM documents GROUP BY source")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.round(F.sum("n_chars") / F.lit(1048576.0), 2).alias("size_mb"))


@query("l3_l8_first_traces_in_order", "SELECT label AS traj_id, vec_id AS frame_idx FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 20")
def _(t: Tables) -> DataFrame:
    return S.first_frames(t.arrays(), 20, ["traj_id"]).select("traj_id", "frame_idx")


@query("x14_magnitude_phase", "SELECT vec_id, round(sqrt(CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) * CAST(embedding[2] AS DOUBLE)), 6) + 0.0 AS mag, round(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)), 6) + 0.0 AS pha FROM embeddings")
def _(t: Tables) -> DataFrame:
    re, im = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    return t.embeddings.select("vec_id", r6(N.magnitude(re, im)).alias("mag"), r6(N.phase(re, im)).alias("pha"))


_WINDOWS = ("hanning", "parzen", "welch", "gaussian", "sine")


@query("x15_windows", f"WITH g AS (SELECT i, i * 0.01e0 AS k FROM (SELECT unnest(range(350)) AS i)) SELECT CAST(i AS INTEGER) AS i, {', '.join(f'round({_window_sql(w)}, 6) + 0.0 AS {w}' for w in _WINDOWS)} FROM g")
def _(t: Tables) -> DataFrame:
    g = t.spark.range(350).select(F.col("id").cast("int").alias("i"), (F.col("id").cast("double") * F.lit(0.01)).alias("k"))
    return g.select("i", *(r6(N.ft_window(F.col("k"), w, FT.kmin, FT.kmax, FT.dk)).alias(w) for w in _WINDOWS))


def _i0_sql(x: str) -> str:
    """The series of the Bessel function I0, 31 terms."""
    return "(1.0e0" + "".join(f" + pow(({x}) / 2, {2 * i}) / {math.factorial(i) ** 2}.0e0" for i in range(1, 32)) + ")"


_MID, _HALF = (FT.kmin + FT.kmax) / 2, (FT.kmax - FT.kmin) / 2


@query("x15_kaiser_window", f"WITH g AS (SELECT CAST(i AS INTEGER) AS i, 1.0e0 - pow((i * 0.01e0 - {_MID}e0) / {_HALF}e0, 2) AS u FROM (SELECT unnest(range(350)) AS i)) SELECT i, round(CASE WHEN u >= 0 THEN ({_i0_sql(f'{FT.dk}e0 * sqrt(greatest(u, 0.0e0))')} - 1.0e0) / ({_i0_sql(f'{FT.dk}e0')} - 1.0e0) ELSE 0.0e0 END, 6) + 0.0 AS kaiser FROM g")
def _(t: Tables) -> DataFrame:
    g = t.spark.range(350).select(F.col("id").cast("int").alias("i"), (F.col("id").cast("double") * F.lit(0.01)).alias("k"))
    return g.select("i", r6(N.ft_window(F.col("k"), "kaiser", FT.kmin, FT.kmax, FT.dk)).alias("kaiser"))


@query("x18_masked_select", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.1e0)) AS INTEGER) AS n, round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.1e0), lambda x: CAST(x AS DOUBLE))), 0), 6) + 0.0 AS total FROM embeddings")
def _(t: Tables) -> DataFrame:
    kept = F.filter(F.col("embedding").cast("array<double>"), lambda x: x > 0.1)
    return t.embeddings.select("vec_id", F.size(kept).alias("n"), r6(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("x19_slice_concat_reverse", "SELECT vec_id, CAST(e[1] AS DOUBLE) AS first, CAST(e[4] AS DOUBLE) AS fourth, CAST(len(e) AS INTEGER) AS n FROM (SELECT vec_id, list_concat(embedding[1:3], list_reverse(embedding[1:3])) AS e FROM embeddings)")
def _(t: Tables) -> DataFrame:
    a = F.slice("embedding", 1, 3)
    e = t.embeddings.select("vec_id", F.concat(a, F.reverse(a)).alias("e"))
    return e.select("vec_id", F.get("e", F.lit(0)).cast("double").alias("first"), F.get("e", F.lit(3)).cast("double").alias("fourth"), F.size("e").alias("n"))


@query(
    "e7_path_sum",
    """WITH p AS (SELECT label, vec_id, 2.0e0 AS deg, 2.0e0 + (vec_id % 10) * 0.1e0 AS reff, CAST(i AS INTEGER) AS i, CAST(i AS DOUBLE) * 0.05e0 AS k, CAST(embedding[i + 1] AS DOUBLE) AS e FROM embeddings, (SELECT unnest(range(64)) AS i)),
      g AS (SELECT *, CAST(i // 8 AS INTEGER) AS k_idx FROM p WHERE i % 8 = 0)
      SELECT CAST(label AS VARCHAR) AS dir, CAST(k_idx AS INTEGER) AS k_idx, round(sum(CASE WHEN k > 0 THEN deg * abs(e) * 0.9e0 / (k * reff * reff) * exp(-2 * reff / (10.0e0 + abs(e))) * sin(2 * k * reff + e + e * 2) ELSE 0.0e0 END), 6) + 0.0 AS chi FROM g GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    s = t.spectra().select(F.col("traj_id").cast("string").alias("dir"), F.col("frame_idx").alias("path_id"), "k", F.col("chi").alias("e"))
    rows = s.select("dir", "path_id", "k", F.col("e").alias("real2phc"), F.abs("e").alias("mag"), (F.col("e") * 2).alias("phase"), F.lit(0.9).alias("red"), (10.0 + F.abs("e")).alias("lambda"))
    paths = s.select("dir", "path_id").distinct().withColumn("deg", F.lit(2.0)).withColumn("reff", 2.0 + (F.col("path_id") % 10) * F.lit(0.1))
    return X.path_sum(rows, paths, [i * 0.05 for i in range(0, 64, 8)]).select("dir", "k_idx", r6("chi").alias("chi"))
