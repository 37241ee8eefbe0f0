"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.operators import quality as q
from odweave.operators.network import FlowGraph


@query("qa_duplicates", "SELECT h_geocode, w_geocode, count(*) AS n FROM flows_block GROUP BY ALL HAVING count(*) > 1")
def qa_duplicates(t: Tables) -> DataFrame:
    return q.duplicates(t.flows_block, ["h_geocode", "w_geocode"])


@query(
    "qa_count_profile",
    "SELECT n, count(*) AS keys FROM (SELECT h_geocode, w_geocode, count(*) AS n FROM flows_block GROUP BY ALL) q GROUP BY 1",
)
def qa_count_profile(t: Tables) -> DataFrame:
    return q.count_profile(t.flows_block, ["h_geocode", "w_geocode"])


@query(
    "qa_node_alignment",
    "WITH n AS (SELECT h_geocode AS name FROM flows_pair UNION SELECT w_geocode FROM flows_pair)"
    " SELECT coalesce(n.name, vec_id) AS key, CAST(n.name IS NOT NULL AS BIGINT) AS n_nodes, CAST(vec_id IS NOT NULL AS BIGINT) AS n_positions"
    " FROM n FULL JOIN points ON n.name = vec_id WHERE n.name IS NULL OR vec_id IS NULL",
)
def qa_node_alignment(t: Tables) -> DataFrame:
    graph = FlowGraph.from_flows(t.flows_pair, "h_geocode", "w_geocode")
    return q.alignment(graph.nodes_df, t.points, "name", "vec_id")


@query(
    "qa_lost_rows",
    "SELECT count(*) AS rows, CAST(sum(CAST(floor(o_totalprice / 10000) AS BIGINT)) AS BIGINT) AS commuters FROM orders WHERE o_orderstatus = 'P'",
)
def qa_lost_rows(t: Tables) -> DataFrame:
    return q.lost_rows(t.route_nested, "directions", "commuters")
