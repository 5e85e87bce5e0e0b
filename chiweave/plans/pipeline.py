"""The analysis end to end: structures or solver outputs to averaged chi(k) and chi(R)."""

from __future__ import annotations

import subprocess
import sys
import tempfile
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KSTEP, WEIGHTINGS, SpectrumConfig
from ..errors import FeffRunError, StructureError
from ..functions import keys
from ..operators import sampling, spectra
from ..operators.cache import ResultCache, counters
from ..operators.structure import absorber_ok
from ..sources import files, text
from ..sources.structures import read_structures
from .inputs import solver_inputs

#: One frame's structure text to (k, chi); raises on failure. A runner whose ``reads_input``
#: is true gets the frame's solver input instead.
Runner = Callable[[str, str, SpectrumConfig], tuple[list[float], list[float]]]
#: Called with (done, total, description).
Progress = Callable[[int, int, str], None]


def percent(done: int, total: int) -> float:
    return 100.0 * done / total if total else 100.0


def command_runner(command: str, timeout: float | None = None) -> Runner:
    """A runner that gives the input to an external program: ``command`` runs in a new
    folder of its task that holds feff.inp, must succeed and leave chi.dat there; the
    folder goes when the frame is through."""

    def run(body: str, absorber: str, config: SpectrumConfig) -> tuple[list[float], list[float]]:
        with tempfile.TemporaryDirectory(prefix="chiweave-run-") as at:
            (Path(at) / "feff.inp").write_text(body)
            done = subprocess.run(command, shell=True, cwd=at, capture_output=True, text=True, timeout=timeout)
            if done.returncode or not (Path(at) / "chi.dat").exists():
                raise FeffRunError(f"the solver ended with {done.returncode}: {done.stderr[-500:]}")
            rows = [x.split() for x in (Path(at) / "chi.dat").read_text().splitlines() if x.strip() and not x.lstrip().startswith("#")]
        return [float(r[0]) for r in rows], [float(r[1]) for r in rows]

    run.reads_input = True
    return run


class Reporter:
    """Calls ``progress`` while tasks report frames to an accumulator, at most ``total``."""

    def __init__(self, spark: SparkSession, progress: Progress | None, total: int, what: str = "frames"):
        self.progress, self.total, self.what = progress, total, what
        self.done = spark.sparkContext.accumulator(0)
        self._end = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def _say(self) -> None:
        self.progress(min(self.total, self.done.value), self.total, f"{self.what}: {percent(min(self.total, self.done.value), self.total):.0f} %")

    def _watch(self) -> None:
        seen = -1
        while not self._end.wait(0.2):
            if self.done.value != seen:
                seen = self.done.value
                self._say()

    def __enter__(self) -> Reporter:
        if self.progress:
            self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        if self.progress:
            self._end.set()
            self._thread.join()
            self._say()


@dataclass
class ProcessingResult:
    """``average``: k, chi, chi_std, nframes; ``transform``: r, chir_*; ``frames``: the
    aligned spectra; ``frame_transforms``: chi(R) of each; ``failed``: frames with errors."""

    mode: str
    nframes: int
    average: DataFrame
    transform: DataFrame
    frames: DataFrame
    frame_transforms: DataFrame
    failed: DataFrame
    cache_hits: int = 0
    cache_misses: int = 0
    with_phase: bool = False

    def plot_data(self, weighting: str = "k2chi", frames: int = 100) -> dict[str, DataFrame]:
        """What a figure shows: the weighted mean with its band, chi(R), and frame traces."""
        w = WEIGHTINGS[weighting]
        phase = ["chir_pha"] if self.with_phase else []
        return {"chi": spectra.envelope(self.average, w).orderBy("k_idx"), "chir": self.transform.select("r", "chir_mag", *phase).orderBy("r"), "traces": sampling.first_frames(self.frame_transforms.select("traj_id", "frame_idx").distinct(), frames).join(self.frame_transforms, ["traj_id", "frame_idx"])}

    def save(self, directory: str) -> None:
        """exafs_data.dat (k, chi) and ft_data.dat (R, |chi(R)|), and both as Parquet."""
        spark, at = self.average.sparkSession, directory.rstrip("/")
        for name, x, y, rows in (("exafs_data", "k", "chi", self.average), ("ft_data", "r", "chir_mag", self.transform)):
            rows.select(x, y).orderBy(x).write.mode("overwrite").parquet(f"{at}/{name}.parquet")
            body = text.two_columns(rows, x, y, f"{x.replace('r', 'R')} {y}").collect()[0]["text"]  # one spectrum: a few hundred points
            files.write_text(spark, f"{at}/{name}.dat", body + "\n")


def run_frames(structures: DataFrame, absorber: str, config: SpectrumConfig, runner: Runner, done=None) -> DataFrame:
    """(traj_id, frame_idx, cache_key, k, chi, error): the solver once per row, each
    failure kept as that row's error, so one bad frame never stops the others. Frames are
    spread over ``n_workers`` tasks, by frame unless that is set, or kept in one if the
    configuration is not ``parallel``; ``done`` is an accumulator that counts them."""
    n = config.n_workers if config.parallel else 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t, i, key, body in zip(f["traj_id"], f["frame_idx"], f["cache_key"], f["structure"]):
                try:
                    k, chi = runner(body, absorber, config)
                    rows.append((t, i, key, list(map(float, k)), list(map(float, chi)), None))
                except Exception as e:  # noqa: BLE001  whatever the solver throws belongs to its frame
                    rows.append((t, i, key, None, None, f"{type(e).__name__}: {e}"))
                if done is not None:
                    done.add(1)
            yield pd.DataFrame(rows, columns=["traj_id", "frame_idx", "cache_key", "k", "chi", "error"])

    dealt = structures.repartition(n) if n else structures.repartition("traj_id", "frame_idx")
    return dealt.select("traj_id", "frame_idx", "cache_key", "structure").mapInPandas(run, "traj_id string, frame_idx long, cache_key string, k array<double>, chi array<double>, error string")


class Analyzer:
    """Runs analyses in one session; ``cache_dir`` None keeps no results."""

    def __init__(self, spark: SparkSession, cache_dir: str | None = None, runner: Runner | None = None):
        self.spark, self.runner = spark, runner
        self.cache = ResultCache(spark, cache_dir)

    def __enter__(self) -> Analyzer:
        return self

    def __exit__(self, *_: object) -> None:
        """What computed rows were read back from goes; the cache itself stays."""
        if self.cache.exists():
            files.delete(self.spark, f"{self.cache.path}/_runs")

    def analyse(self, found: DataFrame, config: SpectrumConfig, mode: str = "trajectory", hits: int = 0, misses: int = 0) -> ProcessingResult:
        """From spectra (traj_id, frame_idx, k, chi, error) on. Fails if none is usable."""
        good = sampling.successful(found)
        counts = good.agg(F.count("*").alias("n")).collect()[0]
        if not counts["n"]:
            raise FeffRunError("no frame gave a usable spectrum")
        points = spectra.aligned(good)
        mean = spectra.average(points)
        config = config.override(kstep=config.kstep or spectra.first_step(mean))
        straight, n = spectra.on_grid(mean, config.kstep or KSTEP)
        each, _ = spectra.on_grid(points, config.kstep or KSTEP, ["traj_id", "frame_idx"])
        arrays = each.groupBy("traj_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k_idx", "chi"))), lambda x: x["chi"]).alias("chi"))
        return ProcessingResult(mode, counts["n"], mean, spectra.fourier(straight, config, n), points, spectra.fourier_frames(arrays, config), found.filter("error IS NOT NULL"), hits, misses, config.with_phase)

    def process_output(self, directory: str, config: SpectrumConfig) -> ProcessingResult:
        """frame_*/chi.dat below a directory, or else its own chi.dat."""
        at = directory.rstrip("/")
        if files.glob(self.spark, f"{at}/frame_*/chi.dat"):
            return self.analyse(text.frame_spectra(self.spark, at), config)
        if not files.glob(self.spark, f"{at}/chi.dat"):
            raise FeffRunError(f"no chi.dat in {directory}")
        one = text.chi_dat(text.lines(self.spark, f"{at}/chi.dat"))
        packed = one.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k_idx", "k", "chi"))).alias("p"))
        rows = packed.select(F.lit(at.rsplit("/", 1)[-1]).alias("traj_id"), F.lit(0).cast("long").alias("frame_idx"), F.transform("p", lambda x: x["k"]).alias("k"), F.transform("p", lambda x: x["chi"]).alias("chi"), F.lit(None).cast("string").alias("error"))
        return self.analyse(rows, config, "single_frame")

    def process(self, structure: str | DataFrame, absorber: str, config: SpectrumConfig, trajectory: bool = False, frame_index: int | None = None, progress: Progress | None = None) -> ProcessingResult:
        """A structure file (XYZ, CIF, VASP), or atoms as rows (frame_idx, atom_id, symbol, x,
        y, z): one frame (the last unless an index is given), or every
        ``sample_interval``-th of a trajectory. Needs a runner."""
        if self.runner is None:
            raise FeffRunError("no solver is set; process_output reads spectra that are there")
        named = isinstance(structure, str)
        atoms = read_structures(self.spark, structure) if named else structure.withColumn("file", F.lit("structure"))
        chosen = sampling.every_nth(atoms, config.sample_interval) if trajectory else sampling.frame_at(atoms, -1 if frame_index is None else frame_index, ["file"])
        if chosen.isEmpty():
            raise StructureError("there is no such frame")
        per = chosen.groupBy("file", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("atom_id", "symbol", "x", "y", "z"))).alias("atoms"))
        if not per.filter(~absorber_ok(F.transform("atoms", lambda a: a["symbol"]), absorber)).isEmpty():
            raise StructureError(f"absorber {absorber} is not in every frame")
        parts = F.transform("atoms", lambda a: F.concat_ws(" ", a["symbol"], a["x"].cast("string"), a["y"].cast("string"), a["z"].cast("string")))
        key = keys.cache_key(keys.structure_hash(parts), F.lit(absorber), keys.config_hash(config))
        wanted = per.select(F.lit(Path(structure).stem if named else "structure").alias("traj_id"), F.col("frame_idx").cast("long"), key.alias("cache_key"), F.concat_ws("\n", parts).alias("structure"))
        if getattr(self.runner, "reads_input", False):
            inputs = solver_inputs(chosen, absorber, config, ["frame_idx"]).select(F.col("frame_idx").cast("long"), F.col("text").alias("structure"))
            wanted = wanted.drop("structure").join(inputs, "frame_idx")
        n = counters(wanted, self.cache.read()).collect()[0]
        with Reporter(self.spark, progress, n["hits"] + n["misses"] if config.force_recalculate else n["misses"]) as report:
            found = self.cache.through(wanted, lambda rows: run_frames(rows, absorber, config, self.runner, report.done), config.force_recalculate)
        return self.analyse(found, config, "trajectory" if trajectory else "single_frame", n["hits"], n["misses"])

    def generate(self, structure: str, absorber: str, config: SpectrumConfig, output: str) -> int:
        """Writes the solver input of every frame as frame_NNNN/feff.inp; returns how many."""
        from ..functions.text import frame_name
        from ..sources.structures import write_texts

        atoms = read_structures(self.spark, structure)
        made = solver_inputs(atoms, absorber, config, ["frame_idx"])
        if made.isEmpty():
            raise StructureError(f"absorber {absorber} is in no frame")
        return write_texts(made, output, F.concat(frame_name(F.col("frame_idx")), F.lit("/feff.inp")))

    def run_inputs(self, directory: str, config: SpectrumConfig) -> tuple[int, int]:
        """Runs the solver on every feff.inp in the folder or its frame_* folders, and
        writes chi.dat beside it; returns how many succeeded and failed. Intermediate files
        of former runs go if the configuration says so."""
        from ..sources.structures import remove_outputs, write_texts

        if self.runner is None:
            raise FeffRunError("no solver is set")
        at = directory.rstrip("/")
        inputs = files.glob(self.spark, f"{at}/frame_*/feff.inp") or files.glob(self.spark, f"{at}/feff.inp")
        if not inputs:
            raise FeffRunError(f"no feff.inp in {directory}")
        whole = self.spark.read.text(inputs, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        place = F.regexp_extract("file", r"(?:(frame_\d+)/)?feff\.inp$", 1)
        rows = whole.select(place.alias("traj_id"), F.lit(0).cast("long").alias("frame_idx"), F.lit("").alias("cache_key"), F.col("value").alias("structure"))
        found = files.stored(run_frames(rows, "", config, self.runner))
        good = sampling.successful(found)
        lines = F.transform(F.arrays_zip("k", "chi"), lambda p: F.format_string("%.6f %.8e", p["k"], p["chi"]))
        n = write_texts(good.select("traj_id", F.concat_ws("\n", F.lit("# k chi"), lines).alias("text")), at, F.when(F.col("traj_id") == "", "chi.dat").otherwise(F.concat("traj_id", F.lit("/chi.dat"))))
        if config.cleanup_feff_files:
            remove_outputs(self.spark, at)
        return n, found.count() - n

    def diagnostics(self) -> dict:
        return {"python": sys.version.split()[0], "spark": self.spark.version, "runner": self.runner is not None, "cache": self.cache.info()}
