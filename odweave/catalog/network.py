"""Network operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.operators.aggregates import net_flow
from odweave.operators.network import FlowGraph, highlight, locations

_NODES = "(SELECT h_geocode AS name FROM flows_pair UNION SELECT w_geocode FROM flows_pair)"
_IDS = f"ids AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM {_NODES} n)"
_EDGE = 'h_geocode AS "from", w_geocode AS "to", commuters'


def _graph(t: Tables) -> FlowGraph:
    return FlowGraph.from_flows(t.flows_pair, "h_geocode", "w_geocode")


@query("graph_build", f"SELECT name FROM {_NODES} n")
def graph_build(t: Tables) -> DataFrame:
    return _graph(t).nodes_df


@query(
    "graph_node_ids",
    f"WITH {_IDS} SELECT {_EDGE}, a.id AS from_id, b.id AS to_id FROM flows_pair JOIN ids a ON h_geocode = a.name JOIN ids b ON w_geocode = b.name",
)
def graph_node_ids(t: Tables) -> DataFrame:
    return _graph(t).with_ids().edges_df


@query("graph_filter_edges", f"SELECT {_EDGE} FROM flows_pair WHERE commuters > 15")
def graph_filter_edges(t: Tables) -> DataFrame:
    return _graph(t).filter_edges(F.col("commuters") > 15).edges_df


@query("graph_no_loops", f"SELECT {_EDGE} FROM flows_pair WHERE h_geocode <> w_geocode")
def graph_no_loops(t: Tables) -> DataFrame:
    return _graph(t).drop_loops().edges_df


@query("graph_sort_edges", f"SELECT {_EDGE} FROM flows_pair ORDER BY commuters DESC")
def graph_sort_edges(t: Tables) -> DataFrame:
    return _graph(t).edges(["-commuters"])


@query("graph_nodes_table", f"SELECT name FROM {_NODES} n ORDER BY 1")
def graph_nodes_table(t: Tables) -> DataFrame:
    return _graph(t).nodes()


@query(
    "graph_edges_export",
    f"WITH {_IDS} SELECT a.id AS origin, b.id AS dest, commuters AS count FROM flows_pair JOIN ids a ON h_geocode = a.name"
    " JOIN ids b ON w_geocode = b.name WHERE commuters >= 50",
)
def graph_edges_export(t: Tables) -> DataFrame:
    return _graph(t).filter_edges(F.col("commuters") >= 50).to_flows()


@query("graph_exclude_node", f"SELECT {_EDGE} FROM flows_pair WHERE w_geocode <> 42")
def graph_exclude_node(t: Tables) -> DataFrame:
    return _graph(t).exclude_destination(42).edges_df


@query("graph_from_node", 'SELECT h_tract AS "from", w_tract AS "to", commuters FROM flows_area WHERE h_tract = 3')
def graph_from_node(t: Tables) -> DataFrame:
    return FlowGraph.from_flows(t.flows_area, "h_tract", "w_tract").from_node(3).edges_df


@query(
    "graph_edge_names",
    f"SELECT {_EDGE}, h_geocode AS name FROM flows_pair WHERE h_geocode IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def graph_edge_names(t: Tables) -> DataFrame:
    return _graph(t).edges_of(t.customer.filter("c_mktsegment = 'BUILDING'"), "c_custkey").edges_df


@query(
    "graph_layout",
    f"SELECT {_EDGE}, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y FROM flows_pair"
    " LEFT JOIN points a ON h_geocode = a.vec_id LEFT JOIN points b ON w_geocode = b.vec_id",
)
def graph_layout(t: Tables) -> DataFrame:
    return _graph(t).with_positions(t.points, key="vec_id").edges_df


@query(
    "graph_locations",
    "SELECT row_number() OVER (ORDER BY GEOID) AS id, NAME || ' County, ' || state_name AS name, round(y + s * 5 / 6, 6) AS lat,"
    " round(x + s * 5 / 6, 6) AS lon, GEOID FROM counties JOIN states ON STATEFP = state_code",
)
def graph_locations(t: Tables) -> DataFrame:
    return locations(t.counties, t.states).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query(
    "graph_highlight",
    "SELECT GEOID, NAME, STATEFP, commuters_out, commuters_in, commuters_in - commuters_out AS diff FROM areas JOIN"
    " (SELECT h_tract, CAST(sum(commuters) AS BIGINT) AS commuters_out FROM flows_area GROUP BY 1) o ON GEOID = o.h_tract JOIN"
    " (SELECT w_tract, CAST(sum(commuters) AS BIGINT) AS commuters_in FROM flows_area GROUP BY 1) i ON GEOID = i.w_tract"
    " WHERE GEOID IN (SELECT w_tract FROM flows_area WHERE h_tract = 4) AND commuters_in > 5000",
)
def graph_highlight(t: Tables) -> DataFrame:
    balance = net_flow(t.areas, t.flows_area, "h_tract", "w_tract")
    return highlight(balance, t.flows_area, 4, "h_tract", "w_tract", "commuters_in", 5000)
