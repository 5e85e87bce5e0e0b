"""Column expressions for the line-oriented text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEFF_NUMBERED = r"(?i)^feff\d+\.dat$"
#: Files a finished run may lose besides the numbered ones.
INTERMEDIATE = r"^(feffrun_.*\.log|log.*\.dat|misc\.dat)$"


def tokens(line: Column) -> Column:
    """White-space separated tokens; none of a blank line."""
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def token(line: Column, n: int) -> Column:
    """Token n from 0, or from the end if negative; null where there is none."""
    return F.try_element_at(tokens(line), F.lit(n + 1 if n >= 0 else n))


def numbers(line: Column) -> Column:
    """The tokens as doubles, null where one is no number."""
    return F.transform(tokens(line), lambda t: t.try_cast("double"))


def all_numeric(line: Column, n: int) -> Column:
    xs = numbers(line)
    return (F.size(xs) == n) & F.forall(xs, lambda x: x.isNotNull())


def numeric_line(n: int) -> str:
    """The pattern of a line of exactly ``n`` numbers."""
    number = r"[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|(?i:nan|inf|infinity))"
    return rf"^\s*{number}(?:\s+{number}){{{n - 1}}}\s*$"


def symbol(text: Column) -> Column:
    return F.initcap(F.trim(text))


def frame_name(i: Column) -> Column:
    return F.format_string("frame_%04d", i)


def structure_name(i: Column) -> Column:
    return F.format_string("struct_f%06d.cif", i)


def is_numbered_output(name: Column) -> Column:
    return name.rlike(FEFF_NUMBERED)


def is_removable(name: Column, keep_essential: bool = True) -> Column:
    found = is_numbered_output(name)
    return found | name.rlike(INTERMEDIATE) if keep_essential else found
