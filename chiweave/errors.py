"""What processing can fail with."""


class ProcessingError(Exception):
    """Anything that stops an analysis."""


class FeffRunError(ProcessingError):
    """A solver run, or all of them, gave no usable spectrum."""


class StructureError(ProcessingError):
    """A structure, or the absorber asked of it, is not valid."""
