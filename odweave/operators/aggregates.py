"""Aggregations of flows. All are partial + final hash aggregates, so a dominant key costs no extra."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odweave.functions.semantics import single_value, sort_keys, strict_avg, strict_sum, sum_na_rm
from odweave.operators.joins import join, map_areas
from odweave.session import fits_broadcast


def sum_by(
    df: DataFrame, keys: Sequence[str], col: str, na_rm: bool = False, digits: int | None = None, out: str | None = None
) -> DataFrame:
    total = sum_na_rm(col) if na_rm else strict_sum(col)
    if digits is not None:
        total = F.bround(total, digits)
    return df.groupBy(*keys).agg(total.alias(out or col))


def mean_by(df: DataFrame, keys: Sequence[str], col: str, na_rm: bool = False, out: str | None = None) -> DataFrame:
    mean = F.avg(col) if na_rm else strict_avg(col)
    return df.groupBy(*keys).agg(mean.alias(out or f"mean_{col}"))


def count_by(df: DataFrame, keys: Sequence[str], sort: bool = True, out: str = "n") -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return counted.orderBy(*sort_keys([f"-{out}", *keys])) if sort else counted


def total(df: DataFrame, col: str) -> DataFrame:
    """Whole-table sum as a one-row table."""
    return df.agg(strict_sum(col).alias(col))


def summarize_flows(
    flows: DataFrame,
    xwalk: DataFrame | Mapping[str, DataFrame],
    key: str,
    level: str,
    ends: Mapping[str, str],
    count: str = "S000",
    out: str = "commuters",
    areas: DataFrame | None = None,
    area_key: str = "GEOID",
) -> DataFrame:
    """Fine pairs -> coarse pairs; ``ends`` maps each code column to its area column.

    With a crosswalk small enough to broadcast, both ends are mapped where the flows are read and only coarse partial
    sums are shuffled. A larger crosswalk is shuffled, so fine pairs are summed first to shrink that join's input.
    ``areas`` restricts both ends: it is applied to the crosswalk, whose inner join then drops the other flows early.
    """
    tables = dict(xwalk) if isinstance(xwalk, Mapping) else dict.fromkeys(ends, xwalk)
    if areas is not None:
        tables = {c: join(x, areas, by={level: area_key}, how="semi", na_matches="never") for c, x in tables.items()}
    map_first = all(fits_broadcast(x.select(key, level)) for x in tables.values())
    fine = flows if map_first else sum_by(flows, list(ends), count)
    mapped = map_areas(fine, tables, key, level, ends, "inner" if areas is not None else "left")
    return sum_by(mapped, list(ends.values()), count, out=out)


def area_flows(df: DataFrame, origin: str, dest: str, count: str, area: str = "area") -> DataFrame:
    """Outflow per origin and inflow per destination, both ends read in one scan and one shuffle.

    An area that is never an origin (destination) has a NULL outflow (inflow).
    """
    ends = df.select(
        F.col(count).alias("__n"),
        F.inline(
            F.array(
                F.struct(F.col(origin).alias(area), F.lit(True).alias("__out")),
                F.struct(F.col(dest).alias(area), F.lit(False).alias("__out")),
            )
        ),
    )

    def strict(flag: Column) -> Column:
        missing = F.count_if(flag & F.col("__n").isNull()) > 0
        return F.when(~missing, F.sum(F.when(flag, F.col("__n"))))

    return ends.groupBy(area).agg(
        strict(F.col("__out")).alias(f"{count}_out"), strict(~F.col("__out")).alias(f"{count}_in")
    )


def net_flow(
    areas: DataFrame, flows: DataFrame, origin: str, dest: str, count: str = "commuters", key: str = "GEOID"
) -> DataFrame:
    """In, out and net flow for every area; a missing inflow counts as 0, a missing outflow leaves the net missing."""
    both = area_flows(flows, origin, dest, count, area="__area")
    out = join(areas, both, by={key: "__area"}, na_matches="never").fillna({f"{count}_in": 0})
    return out.withColumn("diff", F.col(f"{count}_in") - F.col(f"{count}_out"))


def route_stats(
    steps: DataFrame,
    keys: Sequence[str] = ("h_tract", "home_address", "w_tract", "work_address"),
    duration: str = "duration",
    distance: str = "distance",
    commuters: str = "commuters",
) -> DataFrame:
    """One row per route: summed duration and distance, number of steps, the route's constant commuter count."""
    return steps.groupBy(*keys).agg(
        strict_sum(duration).alias(duration),
        strict_sum(distance).alias(distance),
        F.count(F.lit(1)).alias("steps"),
        single_value(commuters).alias(commuters),
    )


def add_share(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Share of the whole table's sum on every row; the total is a scalar subquery, not a global window."""
    share = F.try_divide(F.col(col), df.agg(strict_sum(col)).scalar())
    return df.withColumn(out or f"pct_{col}", share)


def with_totals(df: DataFrame, key: str, label: str = "Total") -> DataFrame:
    """Append a totals row: the key becomes text, numeric columns are summed without the missing values."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != key}
    fields = [f for f in df.schema if f.name != key]
    totals = df.agg(
        F.lit(label).alias(key),
        *[(sum_na_rm(f.name) if f.name in numeric else F.max(F.lit(None).cast(f.dataType))).alias(f.name) for f in fields],
    )
    return df.withColumn(key, F.col(key).cast("string")).unionByName(totals)


def flows_by_name(areas: DataFrame, flows: DataFrame, area: str, name: str, count: str, by: str = "GEOID") -> DataFrame:
    """Attach flows to areas and sum per area name. Flows are summed per area first, so the join stays one row per
    area; an area without flows leaves its name's sum missing, as a strict sum over the joined rows does."""
    return sum_by(join(areas, sum_by(flows, [area], count), by={by: area}), [name], count)
