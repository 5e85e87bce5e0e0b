"""A PySpark engine for ensembles of X-ray absorption spectra."""

from .config import SpectrumConfig
from .errors import FeffRunError, ProcessingError, StructureError

__all__ = ["FeffRunError", "ProcessingError", "SpectrumConfig", "StructureError"]
