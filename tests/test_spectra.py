import numpy as np
import pytest
from pyspark.sql import functions as F

from chiweave.config import WINDOWS, SpectrumConfig
from chiweave.errors import FeffRunError, StructureError
from chiweave.functions import numeric as N
from chiweave.operators import sampling, spectra
from chiweave.plans.pipeline import Analyzer


@pytest.fixture
def frames(tmp_path):
    """Five frames of three points, chi = base + 0.01 i; one more that cannot be read."""
    for i in range(5):
        d = tmp_path / "run" / f"frame_{i:04d}"
        d.mkdir(parents=True)
        (d / "chi.dat").write_text("# output\n" + "".join(f"{k:.1f} {base + 0.01 * i:.6f} 0.1 0.2\n" for k, base in ((1, 0.1), (2, 0.2), (3, 0.3))))
    d = tmp_path / "run" / "frame_0005"
    d.mkdir()
    (d / "chi.dat").write_text("# nothing\nnot numbers\n")
    return str(tmp_path / "run")


def test_process_output_means_and_isolation(spark, frames):
    r = Analyzer(spark).process_output(frames, SpectrumConfig())
    rows = r.average.orderBy("k").collect()
    assert r.nframes == 5
    assert [round(x["chi"], 6) for x in rows] == [0.12, 0.22, 0.32]
    assert all(abs(x["chi_std"] - 0.01 * 2**0.5) < 1e-9 for x in rows)
    assert [x["frame_idx"] for x in r.failed.collect()] == [5]


def test_save_and_plot_data(spark, frames, tmp_path):
    r = Analyzer(spark).process_output(frames, SpectrumConfig())
    r.save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "exafs_data.dat").read_text().startswith("# k chi\n1.000000 0.120000")
    assert {x["low"] <= x["chi_w"] <= x["high"] for x in r.plot_data()["chi"].collect()} == {True}


def test_no_usable_frame_is_an_error(spark, tmp_path):
    with pytest.raises(FeffRunError):
        Analyzer(spark).process_output(str(tmp_path), SpectrumConfig())


def test_frames_are_numbered_not_sorted_by_name(spark, tmp_path):
    for i in (9999, 10000):
        d = tmp_path / f"frame_{i:04d}"
        d.mkdir()
        (d / "chi.dat").write_text("0.0 1.0\n")
    from chiweave.sources.text import frame_spectra

    assert [r["frame_idx"] for r in frame_spectra(spark, str(tmp_path)).orderBy("frame_idx").collect()] == [9999, 10000]


def test_named_columns_in_any_order(spark, tmp_path):
    (tmp_path / "chi.dat").write_text("# chi mag k\n0.5 1.0 2.0\n")
    from chiweave.sources.text import chi_dat, lines

    r = chi_dat(lines(spark, str(tmp_path / "chi.dat"))).collect()[0]
    assert (r["k"], r["chi"], r["mag"], r["phase"]) == (2.0, 0.5, 1.0, None)


@pytest.mark.parametrize("seed", range(3))
def test_interpolation_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    x, g = np.sort(rng.uniform(0, 10, 30)), np.sort(rng.uniform(-1, 11, 50))
    y = rng.normal(size=30)
    knots = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "s int, x double, y double")
    grid = spark.createDataFrame([(1, float(a)) for a in g], "s int, x double")
    got = [r["y"] for r in spectra.interpolate(knots, grid, ["s"]).orderBy("x").collect()]
    assert np.allclose(got, np.interp(g, x, y, left=0, right=0), atol=1e-12)


def test_repeated_knots_count_as_their_mean(spark):
    knots = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 3.0), (1, 2.0, 4.0)], "s int, x double, y double")
    grid = spark.createDataFrame([(1, 1.0), (1, 1.5)], "s int, x double")
    assert [r["y"] for r in spectra.interpolate(knots, grid, ["s"]).orderBy("x").collect()] == [2.0, 3.0]


def test_alignment_keeps_equal_grids_and_moves_others(spark):
    rows = [("t", 0, [0.0, 1.0, 2.0], [0.0, 1.0, 2.0]), ("t", 1, [0.0, 0.5, 2.0], [0.0, 5.0, 20.0]), ("t", 2, [0.0, 1.0], [3.0, 4.0])]
    df = spark.createDataFrame(rows, "traj_id string, frame_idx int, k array<double>, chi array<double>")
    got = {(r["frame_idx"], r["k_idx"]): r["chi"] for r in spectra.aligned(df).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): 2.0, (1, 0): 0.0, (1, 1): 10.0, (1, 2): 20.0, (2, 0): 3.0, (2, 1): 4.0, (2, 2): 0.0}


@pytest.mark.parametrize("window", WINDOWS)
def test_windows_equal_numpy_and_stay_in_bounds(spark, window):
    c = SpectrumConfig(kmin=2, kmax=8, dk=1.5, dk2=2.5, window=window)
    k = np.arange(0, 10, 0.05)
    df = spark.createDataFrame([(float(x),) for x in k], "k double")
    got = np.array([r[0] for r in df.select(N.ft_window(F.col("k"), window, 2, 8, 1.5, 2.5)).collect()])
    assert np.allclose(got, spectra.window_values(k, c), atol=1e-9)
    assert got.min() >= -1e-12 and got.max() <= 1 + 1e-12


def test_transform_equals_fft_both_ways_and_is_linear(spark):
    c = SpectrumConfig(kmin=0.5, kmax=2.5, dk=0.5)
    rng = np.random.default_rng(0)
    chi = rng.normal(size=(3, 64))
    k = np.arange(64) * 0.05
    long = spark.createDataFrame([("t", i, j, float(k[j]), float(chi[i, j])) for i in range(3) for j in range(64)], "traj_id string, frame_idx long, k_idx int, k double, chi double")
    wide = spark.createDataFrame([("t", i, [float(v) for v in chi[i]]) for i in range(3)], "traj_id string, frame_idx long, chi array<double>")
    z = np.fft.fft(chi * k**2 * spectra.window_values(k, c), 2048)[:, : spectra.n_radii(c)] * 0.05 / np.sqrt(np.pi)
    by_join = spectra.fourier(long, c, 64, ("traj_id", "frame_idx")).orderBy("frame_idx", "m").collect()
    by_fft = spectra.fourier_frames(wide, c).orderBy("frame_idx", "m").collect()
    for rows in (by_join, by_fft):
        assert np.allclose([complex(r["chir_re"], r["chir_im"]) for r in rows], z.ravel(), atol=1e-12)
    mean = spectra.fourier(spectra.average(long), c, 64).orderBy("m").collect()
    assert np.allclose([complex(r["chir_re"], r["chir_im"]) for r in mean], z.mean(0), atol=1e-12)
    assert spectra.n_radii(SpectrumConfig()) == 326


def test_average_does_not_depend_on_frame_order(spark):
    rows = [("t", i, 0, 0.0, float(i)) for i in range(10)]
    make = lambda r: spectra.average(spark.createDataFrame(r, "traj_id string, frame_idx int, k_idx int, k double, chi double")).collect()
    assert make(rows) == make(rows[::-1])


def test_sampling(spark):
    df = spark.range(10).withColumnRenamed("id", "frame_idx")
    ids = lambda x: sorted(r["frame_idx"] for r in x.collect())
    assert ids(sampling.every_nth(df, 4)) == [0, 4, 8]
    assert ids(sampling.frame_at(df, -1)) == [9] and ids(sampling.frame_at(df, -3)) == [7] and ids(sampling.frame_at(df, 2)) == [2]
    assert ids(sampling.window_slice(df, 2, 3, 2)) == [2, 5] and ids(sampling.window_slice(df, 2, 3, 0)) == []
    with pytest.raises(ValueError):
        sampling.every_nth(df, 0)


def test_process_uses_the_cache_and_isolates_failures(spark, tmp_path):
    xyz = tmp_path / "t.xyz"
    xyz.write_text("".join(f"2\ncomment {i}\nFe 0 0 0.{i}\nO 1 0 0\n" for i in range(4)))

    def runner(body, absorber, config):
        z = float(body.split("\n")[0].split()[3])
        if z > 0.25:
            raise RuntimeError("no convergence")
        return [0.0, 0.05, 0.1], [0.0, z, 2 * z]

    run = Analyzer(spark, str(tmp_path / "cache"), runner)
    first = run.process(str(xyz), "Fe", SpectrumConfig(), trajectory=True)
    assert (first.nframes, first.cache_hits, first.cache_misses) == (3, 0, 4)
    again = run.process(str(xyz), "fe", SpectrumConfig(kmin=3.0), trajectory=True)
    assert again.nframes == 3
    again = run.process(str(xyz), "Fe", SpectrumConfig(kmin=3.0), trajectory=True)  # a transform setting: same spectra
    assert (again.cache_hits, again.cache_misses) == (3, 1)
    assert run.cache.info()["files"] > 0
    run.cache.clear()
    assert run.cache.info()["files"] == 0
    with pytest.raises(StructureError):
        run.process(str(xyz), "Cu", SpectrumConfig())


def test_interpolation_of_one_long_series_is_linear_work(spark):
    import time

    n = 80_000
    knots = spark.range(n).selectExpr("0 AS s", "id * 1.0D AS x", "sin(id * 0.01D) AS y", "cos(id * 0.01D) AS z")
    grid = spark.range(n - 1).selectExpr("0 AS s", "id + 0.25D AS x")
    start = time.time()
    got = spectra.interpolate(knots, grid, ["s"], y=["y", "z"]).toPandas().sort_values("x")
    assert time.time() - start < 30
    i = np.arange(n)
    for c, f in (("y", np.sin), ("z", np.cos)):
        assert np.allclose(got[c], np.interp(np.arange(n - 1) + 0.25, i, f(i * 0.01)))


def at_grid(spark, k, frames=2):
    return spark.createDataFrame([("t", j, k.tolist(), np.sin(4 * k).tolist(), None) for j in range(frames)], "traj_id string, frame_idx long, k array<double>, chi array<double>, error string")


def test_the_transform_follows_the_spectrums_own_grid(spark):
    config = SpectrumConfig(kmin=2, kmax=12)
    for k in (1 + 0.1 * np.arange(150), np.concatenate([[0, 0.1], np.cumsum(0.1 + 0.05 * np.sin(np.arange(150))) + 0.1])):
        got = Analyzer(spark).analyse(at_grid(spark, k), config)
        mean = got.transform.toPandas().sort_values("m")
        assert abs(mean["r"][mean["chir_mag"].idxmax()] - 2.0) < 0.1  # chi = sin(2 k R), R = 2
        step = k[1] - k[0]
        grid = step * np.arange(int(np.floor(k.max() / step + 1e-6)) + 1)
        x = np.interp(grid, k, np.sin(4 * k), left=0, right=0) * grid**2 * spectra.window_values(grid, config)
        want = np.abs([(x * np.exp(-2j * np.pi * np.arange(len(grid)) * m / 2048)).sum() for m in mean["m"]]) * step / np.sqrt(np.pi)
        assert np.allclose(mean["chir_mag"], want)
        for _, f in got.frame_transforms.toPandas().groupby("frame_idx"):
            assert np.allclose(f.sort_values("m")["chir_mag"], mean["chir_mag"])


def test_a_spectrum_longer_than_the_transform(spark):
    config = SpectrumConfig(kmin=0.5, kmax=3, nfft=32, kstep=0.05, rmax_out=20)
    k = 0.05 * np.arange(81)
    got = Analyzer(spark).analyse(at_grid(spark, k), config)
    mean = got.transform.toPandas().sort_values("m")["chir_mag"].to_numpy()
    for _, f in got.frame_transforms.toPandas().groupby("frame_idx"):
        assert np.allclose(f.sort_values("m")["chir_mag"], mean)
