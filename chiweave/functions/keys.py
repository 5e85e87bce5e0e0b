"""Content keys for reuse of results."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SpectrumConfig


def structure_hash(parts: Column) -> Column:
    """16 hex digits of the MD5 of an array of text parts in full precision."""
    return F.substring(F.md5(F.concat_ws("|", parts)), 1, 16)


def config_hash(config: SpectrumConfig) -> Column:
    """Of every setting that a spectrum depends on; transform settings leave it alone."""
    return F.substring(F.md5(F.lit(json.dumps(config.chi_settings(), sort_keys=True))), 1, 16)


def cache_key(structure: Column, absorber: Column, config: Column) -> Column:
    return F.concat_ws("_", structure, absorber, config)
