"""Checks on keys, multiplicities and alignment, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.functions.semantics import sort_keys


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, most frequent first."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counted.orderBy(*sort_keys(["-n", *keys]))


def count_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys occur n times."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


def alignment(nodes: DataFrame, positions: DataFrame, node_key: str, pos_key: str) -> DataFrame:
    """Keys present in only one of the two tables, or a different number of times. Empty means aligned."""
    sides = nodes.select(F.col(node_key).alias("key"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        positions.select(F.col(pos_key), F.lit(0), F.lit(1))
    )
    counted = sides.groupBy("key").agg(F.sum("a").alias("n_nodes"), F.sum("b").alias("n_positions"))
    return counted.filter("n_nodes != n_positions")


def missing_rows(df: DataFrame, col: str = "geometry") -> DataFrame:
    """Rows whose geometry (or any other column) is missing."""
    return df.filter(F.col(col).isNull())


def lost_rows(df: DataFrame, col: str, weight: str) -> DataFrame:
    """Rows and weight lost to a missing ``col``."""
    return missing_rows(df, col).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(weight), F.lit(0)).alias(weight)
    )
