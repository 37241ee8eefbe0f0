"""Long and wide forms, grids, nested steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.functions.semantics import strict_avg, whole
from odweave.functions.text import parse_number, str_remove
from odweave.operators.joins import join
from odweave.operators.verbs import cols_starts_with
from odweave.operators.windows import add_row_id, weighted_quantiles
from odweave.session import materialize


def unpivot(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], names_to: str = "name", values_to: str = "value"
) -> DataFrame:
    """Columns to (name, value) rows; missing values are kept."""
    return df.unpivot(list(ids), list(cols), names_to, values_to)


def endpoints(df: DataFrame, cols: Sequence[str], out: str = "GEOID") -> DataFrame:
    """Every value that occurs in one of the columns, once."""
    return df.select(F.explode(F.array(*cols)).alias(out)).distinct()


def flags_to_rows(
    df: DataFrame, flags: Sequence[str], ids: Sequence[str], prefix: str = "", names_to: str = "name"
) -> DataFrame:
    """One row per TRUE flag, the flag's name without its prefix."""
    long = unpivot(df.select(*ids, *flags), ids, flags, names_to, "value").filter("value")
    return long.withColumn(names_to, str_remove(names_to, "^" + prefix)) if prefix else long


def endpoint_mean(
    df: DataFrame, origin: str, dest: str, col: str, name: str = "name", value: str = "value", out: str | None = None
) -> DataFrame:
    """Mean of ``col`` per (role, area), where the role is the name of the end's column."""
    long = unpivot(df.select(origin, dest, col), [col], [origin, dest], name, value)
    return long.groupBy(name, value).agg(strict_avg(col).alias(out or f"avg_{col}"))


def pivot(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, names: Sequence[str], fill: object = None
) -> DataFrame:
    """Rows to columns for the given names; ``fill`` goes into absent cells only, a missing value stays missing.

    Two rows for one cell are an error.
    """

    def cell(n: str) -> Column:
        here = F.col(names_from) == F.lit(n)
        twice = F.raise_error(F.lit(f"two rows for one cell of column {n}"))
        value = F.when(F.count_if(here) > 1, twice).otherwise(F.first(F.when(here, F.col(values_from)), ignorenulls=True))
        return (value if fill is None else F.when(F.count_if(here) > 0, value).otherwise(F.lit(fill))).alias(n)

    return df.groupBy(*ids).agg(*[cell(n) for n in names])


#: Rows and bytes (written out as text) of a side that is sent whole to the tasks of the other one.
_SMALL_SIDE, _SMALL_BYTES = 10_000, 8 << 20


def _small(side: DataFrame) -> bool:
    """Is the side measured to be short and narrow? Reads no more than ``_SMALL_SIDE`` rows and one."""
    size = F.sum(F.octet_length(F.struct("*").cast("string")))
    rows, size = side.limit(_SMALL_SIDE + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return rows <= _SMALL_SIDE and size <= _SMALL_BYTES


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` with every row of ``right``. The product is the wanted result, so its size is the cost.

    A side measured to be small, in rows and in bytes, is broadcast and nothing is shuffled. Two large sides are cut into about
    sqrt(2 x shuffle partitions) blocks by hash and each is repeated once per block of the other, which makes the blocks of
    the product evenly sized tasks of an equi join.
    """
    for side, other in ((right, left), (left, right)):
        if _small(side):
            met = other.withColumn("__one", F.lit(1)).join(F.broadcast(side.withColumn("__one", F.lit(1))), "__one")
            return met.select(*left.columns, *right.columns)
    blocks = ceil(sqrt(2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def block(df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).cast("int")

    l = left.withColumn("__row", block(left)).withColumn("__col", every)
    r = right.withColumn("__col", block(right)).withColumn("__row", every)
    return l.join(r, ["__row", "__col"]).drop("__row", "__col")


def complete(df: DataFrame, cols: Sequence[str], fill: Mapping[str, object] | None = None) -> DataFrame:
    """All combinations of the observed values (missing counts as one); absent rows are added, ``fill`` applies to
    missing cells of any row."""
    cells = df.select(cols[0]).distinct()
    for c in cols[1:]:
        cells = grid(cells, df.select(c).distinct())
    out = join(cells, df, by=list(cols))
    out = out.fillna({k: v for k, v in (fill or {}).items() if v is not None})
    return out.select(*df.columns)


# fixed values: how the two ends of a flow are labelled
ROLE_LABELS = ("Origin tract", "Destination tract")


def role_panel(
    areas: DataFrame,
    df: DataFrame,
    origin: str,
    dest: str,
    col: str,
    key: str = "GEOID",
    labels: tuple[str, str] = ROLE_LABELS,
    out: str | None = None,
) -> DataFrame:
    """Every area once per role with the mean of ``col``; labels carry an explicit display order.

    The two roles are known, so the grid is an ``explode`` and the means come with one left join.
    """
    out = out or f"avg_{col}"
    means = endpoint_mean(df, origin, dest, col, name="__role", value=key, out=out)
    roles = F.array(
        *[
            F.struct(F.lit(c).alias("__role"), F.lit(label).alias("name"), F.lit(i).alias("name_ord"))
            for i, (c, label) in enumerate(zip((origin, dest), labels))
        ]
    )
    panel = join(areas.select("*", F.inline(roles)), means, by=[key, "__role"], na_matches="never")
    return panel.drop("__role")


def uncount(df: DataFrame, weight: str, chunk: int = 10_000) -> DataFrame:
    """Repeat each row ``weight`` times and drop the weight; rows with weight 0 or missing vanish, a fraction is an error.

    A row heavier than ``chunk`` is first cut into chunks that are spread over all tasks, so neither one array nor
    one task has to hold its full weight.
    """
    keep = [c for c in df.columns if c != weight]
    w = whole(weight)
    step = F.lit(chunk).cast("bigint")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = df.filter((w > 0) & (w <= chunk)).select(*keep, w.cast("int").alias("__n"))
    cut = df.filter(w > chunk).select(*keep, w.alias("__w"), F.explode(F.sequence(F.lit(0).cast("bigint"), w - 1, step)).alias("__start"))
    heavy = cut.repartition(tasks).select(*keep, F.least(F.col("__w") - F.col("__start"), step).cast("int").alias("__n"))
    return light.unionAll(heavy).select(*keep, F.explode(F.array_repeat(F.lit(1), F.col("__n"))).alias("__one")).drop("__one")


def unnest(df: DataFrame, col: str, keep_empty: bool = False) -> DataFrame:
    """Nested array of structs to rows; empty and missing lists are dropped unless kept as a row of NULLs."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.inline_outer(col) if keep_empty else F.inline(col))


def matrix_to_long(df: DataFrame, prefix: str, row_id: str, col_id: str, value: str) -> DataFrame:
    """Matrix with a row id column and columns ``prefix1, prefix2, ...`` to (row, column, value) rows."""
    cols = cols_starts_with(df.drop(row_id), prefix)
    long = unpivot(df.select(row_id, *cols), [row_id], cols, col_id, value)
    return long.withColumns({col_id: parse_number(str_remove(col_id, "^" + prefix)), row_id: parse_number(row_id)})


def level_ranks(
    df: DataFrame, col: str, by: str | None = None, reverse: bool = False, out: str | None = None, **scan
) -> DataFrame:
    """Each level of a category with its place: alphabetical, or by the median of ``by`` (missing values left out)."""
    out = out or f"{col}_ord"
    levels, order = df.select(col).distinct(), [f"-{col}" if reverse else col]
    if by is not None:
        levels = join(levels, weighted_quantiles(df, by, [0.5], by=[col], out=["__mid"], **scan), by=col)
        order = ["-__mid" if reverse else "__mid", col]
    return add_row_id(levels, order, out, **scan).select(col, out)


def level_order(
    df: DataFrame, col: str, by: str | None = None, reverse: bool = False, out: str | None = None, **scan
) -> DataFrame:
    """Display order of a category as an integer column next to it."""
    return join(df, level_ranks(df, col, by, reverse, out, **scan), by=col)


def tile_matrix(df: DataFrame, origin: str, dest: str, value: str, weight: str, **scan) -> DataFrame:
    """Full origin x destination grid of ``value``, both axes ordered by the median weight of their flows."""
    base = materialize(df.select(origin, dest, value, weight))
    axes = [level_ranks(base, axis, weight, **scan) for axis in (origin, dest)]
    full = join(grid(*axes), base, by=[origin, dest])
    return full.select(origin, dest, value, weight, f"{origin}_ord", f"{dest}_ord")
