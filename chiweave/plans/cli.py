"""Command line: ``python -m chiweave.plans.cli COMMAND``. Exit code 0, 1 for a failure
of the work, 2 for wrong usage."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from ..config import EDGES, METHODS, PRESETS, WEIGHTINGS, WINDOWS, SpectrumConfig
from ..errors import ProcessingError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chiweave")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info", help="versions and state")
    c = sub.add_parser("config-example", help="write an example configuration")
    c.add_argument("output", type=Path)
    c.add_argument("--preset", choices=list(PRESETS))
    c = sub.add_parser("process-output", help="average and transform spectra that are there")
    c.add_argument("directory")
    c.add_argument("--output", required=True)
    for flag in ("--dk2", "--kstep"):
        c.add_argument(flag, type=float)
    c.add_argument("--nfft", type=int)
    c.add_argument("--with-phase", action="store_true", default=None)
    c.add_argument("--traces", action="store_true", help="also save chi(R) of up to 100 frames")
    for name, what in (("process", "run the solver on a structure or trajectory"), ("generate", "write solver inputs")):
        c = sub.add_parser(name, help=what)
        c.add_argument("structure")
        c.add_argument("absorber", help="an element, or a site's number from 0")
        c.add_argument("--output", required=True)
        c.add_argument("--edge", choices=list(EDGES))
        c.add_argument("--method", choices=list(METHODS))
        c.add_argument("--radius", type=float)
        if name == "process":
            c.add_argument("--trajectory", action="store_true")
            c.add_argument("--frame-index", type=int)
            c.add_argument("--interval", dest="sample_interval", type=int)
            c.add_argument("--workers", dest="n_workers", type=int)
            c.add_argument("--cache-dir")
            c.add_argument("--force", dest="force_recalculate", action="store_true", default=None)
            c.add_argument("--with-phase", action="store_true", default=None)
            c.add_argument("--solver", required=True, help="command that turns feff.inp into chi.dat")
    c = sub.add_parser("run-feff", help="run the solver on inputs that are there")
    c.add_argument("directory")
    c.add_argument("--solver", required=True)
    c.add_argument("--keep-files", dest="cleanup_feff_files", action="store_false", default=None)
    c = sub.add_parser("cache", help="show or clear stored results")
    c.add_argument("action", choices=["info", "clear"])
    c.add_argument("--cache-dir", required=True)
    for name in ("process-output", "process", "generate", "run-feff"):
        s = sub.choices[name]
        s.add_argument("--config", type=Path)
        s.add_argument("--preset", choices=list(PRESETS))
        if name in ("generate", "run-feff"):
            continue
        s.add_argument("--window", choices=list(WINDOWS))
        s.add_argument("--chi-weighting", choices=list(WEIGHTINGS))
        for flag, kind in (("kmin", float), ("kmax", float), ("kweight", int), ("dk", float), ("rmax-out", float)):
            s.add_argument(f"--{flag}", type=kind)
    return p


def settings(args: argparse.Namespace) -> SpectrumConfig:
    """File, else preset, else defaults; then only the flags that were given."""
    base = SpectrumConfig.from_yaml(args.config) if args.config else SpectrumConfig.from_preset(args.preset) if args.preset else SpectrumConfig()
    names = {f.name for f in dataclasses.fields(SpectrumConfig)}
    return base.override(**{k: v for k, v in vars(args).items() if k in names})


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "config-example":
            (SpectrumConfig.from_preset(args.preset) if args.preset else SpectrumConfig()).to_yaml(args.output)
            return 0
        from pyspark.sql import SparkSession

        from .pipeline import Analyzer, command_runner

        config = settings(args) if hasattr(args, "config") else None
        spark = SparkSession.builder.appName("chiweave").getOrCreate()
        solver = getattr(args, "solver", None)
        run = Analyzer(spark, getattr(args, "cache_dir", None), command_runner(solver) if solver else None)
        if args.command == "info":
            print(json.dumps(run.diagnostics()))
        elif args.command == "cache":
            if args.action == "clear":
                run.cache.clear()
            print(json.dumps(run.cache.info()))
        elif args.command == "generate":
            print(json.dumps({"inputs": run.generate(args.structure, args.absorber, config, args.output)}))
        elif args.command == "run-feff":
            ok, failed = run.run_inputs(args.directory, config)
            print(json.dumps({"succeeded": ok, "failed": failed}))
            return 0 if ok else 1
        else:
            if args.command == "process":
                say = lambda done, total, what: print(what, file=sys.stderr)
                found = run.process(args.structure, args.absorber, config, args.trajectory, args.frame_index, say)
            else:
                found = run.process_output(args.directory, config)
            found.save(args.output)
            if getattr(args, "traces", False):
                found.plot_data(config.chi_weighting)["traces"].write.mode("overwrite").parquet(f"{args.output.rstrip('/')}/traces.parquet")
            print(json.dumps({"mode": found.mode, "nframes": found.nframes, "cache_hits": found.cache_hits, "cache_misses": found.cache_misses}))
        return 0
    except (ProcessingError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
