"""Area and water tables on disk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.operators.reshape import pivot
from odweave.operators.verbs import rename_map
from odweave.sources.flows import CODE_LENGTH
from odweave.sources.tables import read_table


def read_areas(
    spark: SparkSession,
    path: str,
    level: str | None = None,
    state: str | None = None,
    county: str | None = None,
    variables: Mapping[str, str] | None = None,
    key: str = "GEOID",
) -> DataFrame:
    """Areas of one level, optionally of one state or county (code prefixes, pushed to the scan).

    ``variables`` is ``{new name: variable code}``: wide columns are renamed; a long table with ``variable`` and
    ``value`` columns is turned wide.
    """
    df = read_table(spark, path)
    prefix = (state or "") + (county or "")
    if prefix:
        df = df.filter(F.col(key).startswith(prefix))
    if level:
        df = df.filter(F.length(key) == CODE_LENGTH[level])
    if not variables:
        return df
    if {"variable", "value"} <= set(df.columns):
        ids = [c for c in df.columns if c not in ("variable", "value")]
        df = pivot(df, ids, "variable", "value", list(variables.values()))
    return rename_map(df, {code: name for name, code in variables.items()})


def read_water(spark: SparkSession, path: str) -> DataFrame:
    """Water bodies ``FULLNAME, AWATER, geometry``."""
    return read_table(spark, path).select("FULLNAME", "AWATER", "geometry")
