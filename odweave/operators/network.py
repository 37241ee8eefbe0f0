"""Directed flow networks as a pair of tables (nodes, edges)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.functions.geometry import centroid
from odweave.functions.semantics import sort_keys
from odweave.functions.text import str_c
from odweave.operators.joins import destinations_of, join
from odweave.operators.reshape import endpoints
from odweave.operators.verbs import arrange, min_flow, top_n
from odweave.operators.windows import add_row_id


@dataclass(frozen=True)
class FlowGraph:
    """Nodes carry ``name``; edges carry ``from``, ``to`` (node names) and their attributes."""

    nodes_df: DataFrame
    edges_df: DataFrame

    @classmethod
    def from_flows(cls, df: DataFrame, src: str, dst: str) -> FlowGraph:
        """Nodes are the distinct endpoints, read from both columns in one scan."""
        nodes = endpoints(df, [src, dst], "name").filter(F.col("name").isNotNull())
        return cls(nodes, df.withColumnsRenamed({src: "from", dst: "to"}))

    def filter_edges(self, pred: Column) -> FlowGraph:
        """Filter edges; nodes left without edges stay."""
        return replace(self, edges_df=self.edges_df.filter(pred))

    def drop_loops(self) -> FlowGraph:
        return self.filter_edges(F.col("from") != F.col("to"))

    def exclude_destination(self, node: object) -> FlowGraph:
        """Drop the edges into one node, such as the dominant destination."""
        return self.filter_edges(F.col("to") != F.lit(node))

    def from_node(self, node: object) -> FlowGraph:
        """Edges out of one node."""
        return self.filter_edges(F.col("from") == F.lit(node))

    def edges_of(self, nodes: DataFrame, key: str = "name") -> FlowGraph:
        """Edges whose origin is in a node list, with the origin's name attached."""
        kept = join(self.edges_df, nodes.select(F.col(key).alias("from")), by="from", how="semi", na_matches="never")
        return replace(self, edges_df=kept.withColumn("name", F.col("from")))

    def nodes(self) -> DataFrame:
        """Node table by name."""
        return self.nodes_df.orderBy(*sort_keys(["name"]))

    def edges(self, order: Sequence[str] = ()) -> DataFrame:
        """The edges, in an order if asked for; ties go by a hash of the edge, so that one weight spreads over tasks."""
        return arrange(self.edges_df, *order) if order else self.edges_df

    def with_ids(self, **scan) -> FlowGraph:
        """Dense node ids in name order; edges get the ids of both ends."""
        nodes = add_row_id(self.nodes_df, ["name"], "id", **scan)
        edges = self.edges_df
        for end in ("from", "to"):
            edges = join(edges, nodes.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id")), by=end, na_matches="never")
        return FlowGraph(nodes, edges)

    def with_positions(self, pos: DataFrame, key: str = "GEOID", x: str = "x", y: str = "y") -> FlowGraph:
        """Coordinates on nodes and on both ends of every edge, matched by key."""
        place = pos.select(F.col(key).alias("__k"), F.col(x).alias("x"), F.col(y).alias("y"))
        nodes = join(self.nodes_df, place, by={"name": "__k"}, na_matches="never")
        edges = self.edges_df
        for end in ("from", "to"):
            ends = place.withColumnsRenamed({"x": f"{end}_x", "y": f"{end}_y"})
            edges = join(edges, ends, by={end: "__k"}, na_matches="never")
        return FlowGraph(nodes, edges)

    def to_flows(self, count: str = "commuters") -> DataFrame:
        """origin / dest / count edge list on node ids, heaviest first."""
        edges = self.edges_df if "from_id" in self.edges_df.columns else self.with_ids().edges_df
        flows = edges.select(F.col("from_id").alias("origin"), F.col("to_id").alias("dest"), F.col(count).alias("count"))
        return flows.orderBy(*sort_keys(["-count", "origin", "dest"]))


def locations(
    areas: DataFrame,
    states: DataFrame,
    state_key: str = "STATEFP",
    code_key: str = "state_code",
    state_name: str = "state_name",
    kind: str = "County",
    **scan,
) -> DataFrame:
    """Location table ``id, name, lat, lon, GEOID`` named "X County, State", ids in area-code order."""
    named = join(areas, states.select(code_key, state_name).distinct(), by={state_key: code_key}, na_matches="never")
    c = centroid("geometry")
    placed = named.select(
        "GEOID",
        str_c(str_c(F.col("NAME"), kind, sep=" "), F.col(state_name), sep=", ").alias("name"),
        c["y"].alias("lat"),
        c["x"].alias("lon"),
    )
    return add_row_id(placed, ["GEOID", "name"], "id", **scan).select("id", "name", "lat", "lon", "GEOID")


def highlight(
    areas: DataFrame, flows: DataFrame, at: object, origin: str, dest: str, inflow: str, min_in: float, key: str = "GEOID"
) -> DataFrame:
    """Destinations of one origin whose inflow exceeds a threshold."""
    return min_flow(destinations_of(flows, areas, at, origin, dest, key), inflow, min_in)


def facet_top_k(
    graph: FlowGraph, outflow: DataFrame, k: int, min_count: float, area: str, total: str, count: str = "commuters"
) -> DataFrame:
    """Edges of the k origins with the largest outflow (ties kept), thresholded; ``facet`` names the origin."""
    kept = graph.edges_of(top_n(outflow, k, total), area).filter_edges(F.col(count) > min_count)
    return kept.edges_df.withColumnRenamed("name", "facet")
