"""From the top flows to enriched, repaired and summarised routes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odweave.functions.geometry import centroid
from odweave.operators.aggregates import route_stats
from odweave.operators.enrichment import enrich, failure_report, split_failures
from odweave.operators.joins import join, restrict_to
from odweave.operators.reshape import unnest
from odweave.operators.verbs import drop_self_flows
from odweave.operators.windows import top_share

STEP = T.StructType(
    [
        T.StructField("distance", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("instructions", T.StringType()),
    ]
)


def top_routes(flows: DataFrame, areas: DataFrame, share: float = 0.2, origin: str = "h_tract", dest: str = "w_tract") -> DataFrame:
    """The largest flows between different areas that carry ``share`` of all commuters, with both centroids."""
    inside = drop_self_flows(restrict_to(flows, areas, [dest, origin]), origin, dest)
    top = top_share(inside.select(origin, dest, "commuters"), "commuters", share, [origin, dest])
    middle = areas.select(F.col("GEOID"), centroid("geometry").alias("__at"))
    for end in (origin, dest):
        ends = middle.select(F.col("GEOID").alias(end), F.col("__at").alias(f"{end}_geo"))
        top = join(top, ends, by=end, na_matches="never")
    return top


@dataclass(frozen=True)
class RouteStudy:
    steps: DataFrame
    stats: DataFrame
    failed: DataFrame
    lost: DataFrame


def study_routes(
    routes: DataFrame,
    directions: Callable[..., Any],
    inputs: Sequence[str],
    keys: Sequence[str] = ("h_tract", "w_tract"),
    patches: Mapping[str, Mapping[object, object]] | None = None,
    step: T.StructType = STEP,
    retries: int = 1,
    tasks: int | None = None,
) -> RouteStudy:
    """Ask ``directions`` for the steps of every route, retry failures with patched inputs, summarise per route."""
    done = enrich(routes, directions, inputs, T.ArrayType(step), "directions", patches, retries, tasks)
    ok, failed = split_failures(done, "directions", keys)
    steps = unnest(ok.drop("status", "error"), "directions")
    return RouteStudy(steps, route_stats(steps, [*keys, *inputs]), failed, failure_report(done, "directions", "commuters"))
