"""Missing-value and ordering rules of the flow analyses, stated once.

Sums and means are strict (one missing input makes the result missing) unless the caller asks for
``na_rm``; sorting puts missing values last in both directions; text joins with missing pieces are missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: str | Column) -> Column:
    """Sum that is NULL when any input is NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def sum_na_rm(c: str | Column) -> Column:
    """Sum over the non-missing inputs; 0 when all are missing."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def strict_avg(c: str | Column) -> Column:
    """Mean that is NULL when any input is NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def single_value(c: str | Column) -> Column:
    """The value assumed constant in a group; more than one distinct value is an error."""
    c = _col(c)
    mixed = (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))
    return F.when(mixed, F.raise_error(F.lit("value is not constant within its group"))).otherwise(F.min(c))


def try_num(c: str | Column, to: str = "double") -> Column:
    """Text to number, NULL where it does not parse."""
    return _col(c).try_cast(to)


def whole(c: str | Column) -> Column:
    """A number that must be whole, as bigint; a fraction is an error, a missing value stays missing."""
    c = _col(c)
    number = c.cast("double")
    return F.when(number != F.floor(number), F.raise_error(F.lit("a weight is not a whole number"))).otherwise(c.cast("bigint"))


def na_text(c: str | Column) -> Column:
    """Treat both the empty string and ``NA`` as missing."""
    c = _col(c)
    return F.when(~c.isin("", "NA"), c)


def sort_key(spec: str) -> Column:
    """``"a"`` ascending, ``"-a"`` descending; missing values last either way."""
    return F.col(spec[1:]).desc_nulls_last() if spec.startswith("-") else F.col(spec).asc_nulls_last()


def sort_keys(specs: Sequence[str]) -> list[Column]:
    return [sort_key(s) for s in specs]


def sort_name(spec: str) -> str:
    return spec.removeprefix("-")
