"""Row and column verbs: projections, filters, sorting, top-k, stacking."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odweave.functions.semantics import sort_keys, strict_sum, try_num
from odweave.operators.joins import join


# --- columns -----------------------------------------------------------------------------------------------

def cols_contains(df: DataFrame, text: str) -> list[str]:
    """Columns whose name contains ``text``, ignoring case."""
    return [c for c in df.columns if text.lower() in c.lower()]


def cols_matches(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose name matches a regular expression, ignoring case."""
    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def cols_starts_with(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(text.lower())]


def move_first(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns first, everything else after them."""
    return df.select(*cols, *[c for c in df.columns if c not in cols])


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename ``{old: new}``; also restores names a file format cut to ten characters."""
    return df.withColumnsRenamed(dict(names))


def mutate(df: DataFrame, exprs: Iterable[tuple[str, Column]]) -> DataFrame:
    """Add or replace columns; a later expression sees the earlier ones. Catalyst collapses the projections."""
    for name, expr in exprs:
        df = df.withColumn(name, expr)
    return df


def with_source(df: DataFrame, tag: str, name: str = "source_file") -> DataFrame:
    return df.withColumn(name, F.lit(tag))


# --- rows --------------------------------------------------------------------------------------------------

def min_flow(df: DataFrame, col: str, n: float, inclusive: bool = False) -> DataFrame:
    """Flows above a threshold, strict by default."""
    return df.filter(F.col(col) >= n if inclusive else F.col(col) > n)


def drop_self_flows(df: DataFrame, origin: str, dest: str) -> DataFrame:
    """Remove flows inside one area; rows with a missing end are dropped too, as the comparison is unknown."""
    return df.filter(~(F.col(origin) == F.col(dest)))


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(cols) if cols else None)


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace missing values in the named columns only."""
    return df.fillna(dict(values))


def lookup_map(df: DataFrame, key: str, mapping: Mapping[str, str | None], out: str = "value") -> DataFrame:
    """Look a key up in a small named vector; an unknown key gives NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(key)))


def scalar(df: DataFrame, expr: str | Column) -> Column:
    """One value of a one-row table as a constant for another query (a scalar subquery, run once)."""
    return df.select(expr).scalar()


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key."""
    return df.select(*keys).distinct()


# --- order -------------------------------------------------------------------------------------------------

def row_hash(df: DataFrame) -> Column:
    """A hash over all columns that can be hashed."""
    return F.xxhash64(*[f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def arrange(df: DataFrame, *keys: str) -> DataFrame:
    """Global sort, ``-key`` for descending, missing values last; ties go by a hash of the row.

    The hash lets rows with one value spread over many tasks of the sort.
    """
    return df.orderBy(*sort_keys(keys), row_hash(df))


def arrange_numeric(df: DataFrame, col: str) -> DataFrame:
    """Sort text codes by their numeric value and give them back as text without leading zeros."""
    number = try_num(col, "bigint")
    return df.withColumn(col, number).orderBy(F.col(col).asc_nulls_last(), row_hash(df)).withColumn(col, F.col(col).cast("string"))


def top_k(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """First k rows in a total order, ties cut (TakeOrdered: k rows per task, no full sort)."""
    return df.orderBy(*sort_keys(order)).limit(k)


def top_n(df: DataFrame, k: int, col: str) -> DataFrame:
    """Top k including ties. The k-th value is found with a bounded top-k, then used as a threshold."""
    best = df.filter(F.col(col).isNotNull()).select(col).orderBy(F.col(col).desc()).limit(k)
    return df.filter(F.col(col) >= best.agg(F.min(col)).scalar())


def agg_top_k(df: DataFrame, key: str, col: str, k: int) -> DataFrame:
    """Sum per key, then the k largest; a missing key is a group of its own."""
    sums = df.groupBy(key).agg(strict_sum(col).alias(col))
    return top_k(sums, [f"-{col}", key], k)


# --- stacking ----------------------------------------------------------------------------------------------

def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; absent columns become NULL."""
    out = dfs[0]
    for other in dfs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def replace_rows(main: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: rows of ``main`` whose key is not in ``patch``, then all rows of ``patch``."""
    return union_by_name(join(main, patch, by=list(keys), how="anti"), patch)


