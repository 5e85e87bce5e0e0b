"""The settings of an analysis, immutable; every override validates anew."""

from __future__ import annotations

import dataclasses
import json
import warnings
from dataclasses import dataclass, field
from pathlib import Path

# Domains of the text settings, and the two presets.
SPECTRA = ("EXAFS",)
EDGES = ("K", "L1", "L2", "L3", "M1", "M2", "M3", "M4", "M5")
WINDOWS = ("hanning", "parzen", "welch", "gaussian", "sine", "kaiser")
METHODS = ("auto", "larixite", "pymatgen")
WEIGHTINGS = {"chi": 0, "k2chi": 2, "k3chi": 3}
PRESETS = {
    "quick": {"radius": 8.0, "kmin": 2.0, "kmax": 12.0, "dk": 1.0},
    "publication": {"radius": 12.0, "kmin": 3.0, "kmax": 18.0, "dk": 4.0},
}
NFFT, KSTEP = 2048, 0.05


@dataclass(frozen=True)
class SpectrumConfig:
    spectrum_type: str = "EXAFS"
    edge: str = "K"
    radius: float = 8.0
    method: str = "auto"
    user_tag_settings: dict[str, str] = field(default_factory=dict)
    kmin: float = 2.0
    kmax: float = 14.0
    kweight: int = 2
    dk: float = 1.0  # width of the taper at kmin, and at kmax unless dk2 is set
    dk2: float | None = None
    with_phase: bool = False
    rmax_out: float = 10.0
    window: str = "hanning"
    nfft: int | None = None
    kstep: float | None = None
    parallel: bool = True  # False keeps all frames in one task
    n_workers: int | None = None
    sample_interval: int = 1
    force_recalculate: bool = False
    cleanup_feff_files: bool = True
    chi_weighting: str = "k2chi"

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        for name, domain in (("spectrum_type", SPECTRA), ("edge", EDGES), ("method", METHODS), ("window", WINDOWS), ("chi_weighting", WEIGHTINGS)):
            need(getattr(self, name) in domain, f"{name} must be one of {', '.join(domain)}")
        need(0 <= self.kmin < self.kmax, "kmin must be at least 0 and below kmax")
        need(self.dk > 0 and (self.dk2 is None or self.dk2 > 0), "dk and dk2 must be positive")
        need(self.radius > 0, "radius must be positive")
        need(self.rmax_out > 0, "rmax_out must be positive")
        need(self.n_workers is None or self.n_workers > 0, "n_workers must be positive")
        need(isinstance(self.sample_interval, int) and self.sample_interval >= 1, "sample_interval must be 1 or more")
        if not 1 <= self.kweight <= 3:
            warnings.warn("kweight is usually 1, 2 or 3", stacklevel=2)

    def override(self, **given: object) -> SpectrumConfig:
        """With every given value that is not None."""
        return dataclasses.replace(self, **{k: v for k, v in given.items() if v is not None})

    @classmethod
    def from_preset(cls, name: str) -> SpectrumConfig:
        if name not in PRESETS:
            raise ValueError(f"preset must be one of {', '.join(PRESETS)}")
        return cls(**PRESETS[name])

    @classmethod
    def from_yaml(cls, path: str | Path) -> SpectrumConfig:
        import yaml

        given = yaml.safe_load(Path(path).read_text()) or {}
        if not isinstance(given, dict):
            raise ValueError("the configuration must be a mapping")
        unknown = given.keys() - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)

    def to_yaml(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.as_dict(), sort_keys=False))

    def to_json(self) -> str:
        return json.dumps(self.as_dict())

    @property
    def fourier_params(self) -> dict:
        """The transform's settings that are set."""
        names = ("kmin", "kmax", "kweight", "dk", "dk2", "with_phase", "window", "rmax_out", "nfft", "kstep")
        return {k: v for k in names if (v := getattr(self, k)) is not None}

    def chi_settings(self) -> dict:
        """Everything that a computed spectrum depends on, and nothing of its transform."""
        return {k: getattr(self, k) for k in ("spectrum_type", "edge", "radius", "method", "user_tag_settings")}
