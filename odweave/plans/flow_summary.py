"""Block flows to an area-pair summary, and what the summary says about each area."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.operators.aggregates import net_flow, summarize_flows
from odweave.operators.network import FlowGraph
from odweave.operators.verbs import arrange, drop_incomplete, drop_self_flows


def top_area_pairs(
    flows: DataFrame,
    xwalk: DataFrame | Mapping[str, DataFrame],
    key: str,
    level: str,
    ends: Mapping[str, str],
    count: str = "S000",
    areas: DataFrame | None = None,
    area_key: str = "GEOID",
) -> DataFrame:
    """Which pairs of different areas exchange the most commuters?"""
    origin, dest = ends.values()
    pairs = summarize_flows(flows, xwalk, key, level, ends, count, "commuters", areas, area_key)
    return arrange(drop_self_flows(drop_incomplete(pairs), origin, dest), "-commuters", origin, dest)


def area_balance(areas: DataFrame, pairs: DataFrame, origin: str, dest: str, key: str = "GEOID") -> DataFrame:
    """In-, out- and net flow of every area, excluding flows inside an area."""
    return net_flow(areas, drop_self_flows(drop_incomplete(pairs), origin, dest), origin, dest, "commuters", key)


def main_network(pairs: DataFrame, origin: str, dest: str, positions: DataFrame, min_commuters: float = 100) -> FlowGraph:
    """The thresholded network with node positions."""
    graph = FlowGraph.from_flows(drop_self_flows(drop_incomplete(pairs), origin, dest), origin, dest)
    return graph.filter_edges(F.col("commuters") > min_commuters).with_positions(positions)
