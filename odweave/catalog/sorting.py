"""Sorts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.operators import verbs as v
from odweave.operators.aggregates import sum_by
from odweave.operators.network import FlowGraph, facet_top_k


@query("sort_desc", "SELECT * FROM flows_pair ORDER BY commuters DESC")
def sort_desc(t: Tables) -> DataFrame:
    return v.arrange(t.flows_pair, "-commuters")


@query("sort_asc", "SELECT * FROM flows_pair ORDER BY h_geocode")
def sort_asc(t: Tables) -> DataFrame:
    return v.arrange(t.flows_pair, "h_geocode")


@query("sort_multi", "SELECT * FROM flows_pair ORDER BY h_geocode, w_geocode")
def sort_multi(t: Tables) -> DataFrame:
    return v.arrange(t.flows_pair, "h_geocode", "w_geocode")


@query("sort_numeric_text", "SELECT CAST(h_geocode AS VARCHAR) AS code, commuters FROM flows_pair ORDER BY h_geocode")
def sort_numeric_text(t: Tables) -> DataFrame:
    coded = t.flows_pair.select(F.lpad(F.col("h_geocode").cast("string"), 15, "0").alias("code"), "commuters")
    return v.arrange_numeric(coded, "code")


@query("topk_slice", "SELECT * FROM flows_pair ORDER BY commuters DESC, h_geocode, w_geocode LIMIT 5")
def topk_slice(t: Tables) -> DataFrame:
    return v.top_k(t.flows_pair, ["-commuters", "h_geocode", "w_geocode"], 5)


@query("topk_ties", "SELECT * FROM flows_pair QUALIFY rank() OVER (ORDER BY commuters DESC) <= 10")
def topk_ties(t: Tables) -> DataFrame:
    return v.top_n(t.flows_pair, 10, "commuters")


@query("agg_topk", "SELECT FULLNAME, CAST(sum(AWATER) AS BIGINT) AS AWATER FROM water GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def agg_topk(t: Tables) -> DataFrame:
    return v.agg_top_k(t.water, "FULLNAME", "AWATER", 4)


@query(
    "facet_topk",
    'SELECT f.h_geocode AS "from", f.w_geocode AS "to", commuters, f.h_geocode AS facet FROM flows_pair f JOIN'
    " (SELECT h_geocode FROM (SELECT h_geocode, sum(commuters) AS n FROM flows_pair GROUP BY 1) q"
    " QUALIFY rank() OVER (ORDER BY n DESC) <= 5) top USING (h_geocode) WHERE commuters > 5",
)
def facet_topk(t: Tables) -> DataFrame:
    out = sum_by(t.flows_pair, ["h_geocode"], "commuters", out="commuters_out")
    graph = FlowGraph.from_flows(t.flows_pair, "h_geocode", "w_geocode")
    return facet_top_k(graph, out, 5, 5, "h_geocode", "commuters_out")
