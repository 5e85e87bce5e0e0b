import warnings

import pytest

from chiweave.config import EDGES, WINDOWS, SpectrumConfig
from chiweave.plans import cli


@pytest.mark.parametrize("bad", [{"kmin": -1}, {"kmin": 5, "kmax": 5}, {"dk": 0}, {"dk2": -1}, {"radius": 0}, {"method": "magic"}, {"n_workers": 0}, {"sample_interval": 0}, {"edge": "Z"}, {"window": "box"}, {"spectrum_type": "XANES"}, {"chi_weighting": "k9chi"}])
def test_rejects(bad):
    with pytest.raises(ValueError):
        SpectrumConfig(**bad)


def test_overrides_validate_again():
    with pytest.raises(ValueError):
        SpectrumConfig().override(sample_interval=0)
    assert SpectrumConfig().override(kmin=None, kmax=10.0).kmax == 10.0


def test_kweight_only_warns():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        SpectrumConfig(kweight=5)
    assert seen


def test_yaml_round_trip_keeps_everything(tmp_path):
    c = SpectrumConfig(dk2=2.0, nfft=1024, kstep=0.04, with_phase=True, user_tag_settings={"S02": "0.8"})
    c.to_yaml(tmp_path / "c.yaml")
    assert SpectrumConfig.from_yaml(tmp_path / "c.yaml") == c


def test_yaml_must_be_a_mapping_of_known_settings(tmp_path):
    at = tmp_path / "c.yaml"
    for text in ("- 1\n- 2\n", "no_such: 1\n"):
        at.write_text(text)
        with pytest.raises(ValueError):
            SpectrumConfig.from_yaml(at)


def test_fourier_params_leave_out_what_is_unset():
    assert {"dk2", "nfft", "kstep"}.isdisjoint(SpectrumConfig().fourier_params)
    assert SpectrumConfig(nfft=512).fourier_params["nfft"] == 512


def test_presets_and_domains():
    assert SpectrumConfig.from_preset("publication").kmax == 18
    with pytest.raises(ValueError):
        SpectrumConfig.from_preset("slow")
    for e in EDGES:
        assert SpectrumConfig(edge=e).edge == e
    for w in WINDOWS:
        assert SpectrumConfig(window=w).window == w


def test_only_given_flags_override(tmp_path):
    SpectrumConfig(kmin=3.0).to_yaml(tmp_path / "c.yaml")
    args = cli._parser().parse_args(["process-output", "x", "--output", "y", "--config", str(tmp_path / "c.yaml"), "--kmax", "11"])
    c = cli.settings(args)
    assert (c.kmin, c.kmax) == (3.0, 11.0)


def test_cli_usage_and_failure_codes(tmp_path):
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2
    assert cli.main(["config-example", str(tmp_path / "c.yaml"), "--preset", "quick"]) == 0
    assert SpectrumConfig.from_yaml(tmp_path / "c.yaml") == SpectrumConfig.from_preset("quick")
    (tmp_path / "bad.yaml").write_text("kmin: -3\n")
    assert cli.main(["process-output", str(tmp_path), "--output", str(tmp_path / "o"), "--config", str(tmp_path / "bad.yaml")]) == 1
