"""Sums of floating point numbers that do not depend on the order or the partitioning of the rows.

Every number is split without error into whole digits on one grid of powers of two that suits the column. Digits are summed
as whole numbers, which is exact in any order, and are put together once, at the end. So a sum over groups, a running sum
and a sum of sums give the same double wherever the rows lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a digit: a sum of 2^39 digits still fits into a bigint.
BITS = 24
_LOWEST = -1074  # exponent of the smallest double


def floating(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType))


@dataclass(frozen=True)
class Grid:
    """The digits' powers of two for one column, largest first; ``special`` if it holds infinities or NaN."""

    exponents: tuple[int, ...]
    special: bool = False

    @classmethod
    def of(cls, largest: float | None, smallest: float | None, special: bool = False) -> Grid:
        """The grid for finite values whose absolute values, where not zero, lie between ``smallest`` and ``largest``."""
        if not largest or not smallest:
            return cls((0,), special)
        low = max(math.frexp(smallest)[1] - 53, _LOWEST)
        digits = -((low - math.frexp(largest)[1]) // BITS)
        return cls(tuple(low + BITS * k for k in reversed(range(digits))), special)

    def __len__(self) -> int:
        return len(self.exponents) + 3 * self.special

    def digits(self, col: Column) -> list[Column]:
        """A number as bigints to be summed column by column; all are missing where it is missing."""
        x = col.cast("double")
        finite = F.when(F.isnan(x) | (F.abs(x) == math.inf), F.lit(0.0)).otherwise(x) if self.special else x
        size, out = F.abs(finite), []
        for k, e in enumerate(self.exponents):
            below = size % F.lit(math.ldexp(1.0, e + BITS)) if k else size
            out.append((F.signum(finite) * F.floor(below / F.lit(math.ldexp(1.0, e)))).cast("bigint"))
        if self.special:
            out += [F.when(x.isNotNull(), same.cast("bigint")) for same in (F.isnan(x), x == math.inf, x == -math.inf)]
        return out

    def value(self, sums: Sequence[Column]) -> Column:
        """The double nearest to summed digits, or one beside it; missing where they are missing."""
        digits = sums[: len(self.exponents)]
        sign = F.when(self._carried(digits)[0] < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
        carry, *clean = self._carried([d * sign for d in digits])
        total = F.lit(0.0)
        for digit, e in zip(reversed(clean), reversed(self.exponents), strict=True):
            total = total + digit.cast("double") * F.lit(math.ldexp(1.0, e))
        top = self.exponents[0] + BITS
        above = carry.cast("double") * F.lit(math.ldexp(1.0, top) if top < 1024 else math.inf)
        total = F.when(carry == 0, total).otherwise(total + above) * sign
        if not self.special:
            return total
        nan, plus, minus = sums[len(self.exponents) :]
        special = F.when((nan > 0) | ((plus > 0) & (minus > 0)), F.lit(math.nan)).when(plus > 0, F.lit(math.inf))
        return special.when(minus > 0, F.lit(-math.inf)).otherwise(total)

    @staticmethod
    def _carried(digits: Sequence[Column]) -> list[Column]:
        """Every digit but the first between 0 and 2^BITS; what goes over is in front."""
        carry, clean = F.lit(0).cast("bigint"), []
        for digit in reversed(digits):
            value = digit + carry
            clean.append(value.bitwiseAND(F.lit((1 << BITS) - 1)))
            carry = F.shiftright(value, BITS)
        return [carry, *reversed(clean)]

    def total(self, col: Column) -> Column:
        """An aggregate: the sum of a column, missing if there is no value."""
        return self.value([F.sum(d) for d in self.digits(col)])


def grids(df: DataFrame, cols: Iterable[str]) -> dict[str, Grid]:
    """A grid for each floating point column, from one pass over them; three numbers a column come to the driver."""
    cols = [c for c in dict.fromkeys(cols) if floating(df, c)]
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        size = F.abs(F.col(c).cast("double"))
        finite = ~F.isnan(size) & (size < math.inf)
        aggs += [
            F.max(F.when(finite, size)).alias(f"{i}_max"), F.min(F.when(finite & (size > 0), size)).alias(f"{i}_min"),
            F.bool_or(~finite).alias(f"{i}_special"),
        ]
    found = df.agg(*aggs).first()
    return {c: Grid.of(found[f"{i}_max"], found[f"{i}_min"], bool(found[f"{i}_special"])) for i, c in enumerate(cols)}


def exact_sum_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Sums per group over the values that are there; floating point ones do not depend on the order of the rows."""
    found = grids(df, cols)
    aggs = [found[c].total(F.col(c)) if c in found else F.sum(c) for c in cols]
    return df.groupBy(*keys).agg(*[a.alias(c) for a, c in zip(aggs, cols, strict=True)])
