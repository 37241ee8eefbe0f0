"""Scalar functions on codes, labels and numbers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from odweave.functions.semantics import _col


def area_prefix(c: str | Column, n: int) -> Column:
    """A coarser area code is a prefix of the finer one (block 15 -> tract 11 -> county 5 -> state 2)."""
    return F.substring(_col(c), 1, n)


def str_c(*parts: str | Column, sep: str = "") -> Column:
    """Concatenate; one missing piece makes the result missing. Plain strings are literals."""
    pieces = [F.lit(p) if isinstance(p, str) else p for p in parts]
    if sep:
        pieces = list(chain.from_iterable((F.lit(sep), p) for p in pieces))[1:]
    return F.concat(*pieces)


def str_detect(c: str | Column, pattern: str) -> Column:
    return _col(c).rlike(pattern)


def _first_match(c: str | Column, pattern: str, replacement: str) -> Column:
    # a lazy prefix anchored at the start leaves every later match alone
    return F.regexp_replace(_col(c), f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def str_remove(c: str | Column, pattern: str) -> Column:
    """Delete the first match. An anchored pattern (``^...``) is used as it is."""
    return str_replace(c, pattern, "")


def str_replace(c: str | Column, pattern: str, replacement: str) -> Column:
    """Replace the first match; ``replacement`` is literal text."""
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    if pattern.startswith("^"):
        return F.regexp_replace(_col(c), pattern, literal)
    return _first_match(c, pattern, literal)


def parse_number(c: str | Column) -> Column:
    """First number inside a text, grouping commas ignored."""
    found = F.regexp_extract(_col(c), r"-?(?:\d[\d,]*\.?\d*|\.\d+)", 0)
    return F.regexp_replace(found, ",", "").try_cast("double")


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(_col(c), digits)


def case_when(*branches: tuple[Column, Column | object], default: Column | object = None) -> Column:
    """First true branch wins; without a default the rest is NULL."""
    out = F
    for cond, value in branches:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def patch_value(key: str, bad_key: object, value: str, replacement: object) -> Column:
    """Replace ``value`` for one key; a missing key gives a missing value."""
    hit = F.col(key) == F.lit(bad_key)
    return F.when(hit, F.lit(replacement)).when(~hit, F.col(value))


def format_label(fmt: str, cols: Sequence[str | Column]) -> Column:
    """printf-style label."""
    return F.format_string(fmt, *[_col(c) for c in cols])
