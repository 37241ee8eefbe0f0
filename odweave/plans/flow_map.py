"""Multi-state county flows to the three tables of a flow map."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.operators.joins import restrict_to
from odweave.operators.network import FlowGraph, locations
from odweave.operators.quality import alignment, count_profile, duplicates
from odweave.operators.verbs import union_by_name
from odweave.sources.tables import write_flow_bundle


@dataclass(frozen=True)
class FlowMap:
    nodes: DataFrame
    locations: DataFrame
    flows: DataFrame
    repeated_pairs: DataFrame
    multiplicities: DataFrame
    misaligned: DataFrame

    def write(self, path: str, properties: Mapping[str, str | None], fmt: str = "csv") -> None:
        spark = self.flows.sparkSession
        props = spark.createDataFrame(list(properties.items()), "property string, value string")
        write_flow_bundle(path, props, self.locations, self.flows, fmt)


def flow_map(
    main: DataFrame, aux: DataFrame, counties: DataFrame, states: DataFrame, min_commuters: float = 500,
    origin: str = "h_county", dest: str = "w_county",
) -> FlowMap:
    """Stack both parts, keep flows between known counties, build nodes, edges and locations, and check them.

    A pair that occurs in several files stays several edges, as its multiplicity is part of the checks.
    """
    stacked = union_by_name(main, aux)
    known = restrict_to(stacked, counties, [dest, origin]).select(origin, dest, "commuters")
    graph = FlowGraph.from_flows(known, origin, dest).filter_edges(F.col("commuters") >= min_commuters).with_ids()
    places = locations(counties, states)
    return FlowMap(
        nodes=graph.nodes(),
        locations=places,
        flows=graph.to_flows(),
        repeated_pairs=duplicates(stacked, [origin, dest]),
        multiplicities=count_profile(stacked, [origin, dest]),
        misaligned=alignment(graph.nodes_df, places, "name", "GEOID"),
    )
