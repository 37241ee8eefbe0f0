"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.operators.joins import active_areas, attach, destinations_of, join, map_areas, restrict_to
from odweave.operators.reshape import endpoints
from odweave.operators.travel import network_matrix, od_matrix, to_destination
from odweave.operators.verbs import top_k
from odweave.operators.aggregates import sum_by
from odweave.session import materialize


@query(
    "join_left",
    "SELECT h_geocode, w_geocode, commuters, s_name FROM flows_pair LEFT JOIN supplier ON h_geocode = s_suppkey",
)
def join_left(t: Tables) -> DataFrame:
    return join(t.flows_pair, t.supplier.select("s_suppkey", "s_name"), {"h_geocode": "s_suppkey"})


@query(
    "join_crosswalk_roles",
    "SELECT h_geocode, w_geocode, commuters, c_nationkey AS h_tract, s_nationkey AS w_tract FROM flows_pair"
    " LEFT JOIN customer ON h_geocode = c_custkey LEFT JOIN supplier ON w_geocode = s_suppkey",
)
def join_crosswalk_roles(t: Tables) -> DataFrame:
    return map_areas(t.flows_pair, t.crosswalk, "tabblk2010", "trct", {"h_geocode": "h_tract", "w_geocode": "w_tract"})


@query(
    "join_right",
    "SELECT b.GEOID AS w_geocode, commuters, NAME FROM (SELECT w_geocode, CAST(sum(commuters) AS BIGINT) AS commuters"
    " FROM flows_pair GROUP BY 1) f RIGHT JOIN blocks b ON w_geocode = b.GEOID",
)
def join_right(t: Tables) -> DataFrame:
    flows = sum_by(t.flows_pair, ["w_geocode"], "commuters")
    return join(flows, t.blocks.select("GEOID", "NAME"), {"w_geocode": "GEOID"}, "right")


@query(
    "join_inner",
    "SELECT h_geocode, w_geocode, commuters, most FROM flows_pair JOIN (SELECT h_geocode, w_geocode, max(S000) AS most"
    " FROM flows_block GROUP BY ALL) m USING (h_geocode, w_geocode)",
)
def join_inner(t: Tables) -> DataFrame:
    most = t.flows_block.groupBy("h_geocode", "w_geocode").agg(F.max("S000").alias("most"))
    return join(t.flows_pair, most, ["h_geocode", "w_geocode"], "inner")


@query(
    "join_full",
    "SELECT coalesce(h_geocode, s_suppkey) AS area, commuters, s_name FROM (SELECT h_geocode, CAST(sum(commuters) AS BIGINT)"
    " AS commuters FROM flows_pair GROUP BY 1) f FULL JOIN supplier ON h_geocode = s_suppkey",
)
def join_full(t: Tables) -> DataFrame:
    flows = sum_by(t.flows_pair, ["h_geocode"], "commuters").withColumnRenamed("h_geocode", "area")
    return join(flows, t.supplier.select("s_suppkey", "s_name"), {"area": "s_suppkey"}, "full")


@query("join_semi", "SELECT * FROM blocks WHERE GEOID IN (SELECT h_geocode FROM flows_pair)")
def join_semi(t: Tables) -> DataFrame:
    return join(t.blocks, t.flows_pair, {"GEOID": "h_geocode"}, "semi")


@query(
    "join_semi_both_ends",
    "SELECT * FROM trips WHERE h_tract IN (SELECT GEOID FROM areas WHERE STATEFP = 1) AND w_tract IN (SELECT GEOID FROM areas WHERE STATEFP = 1)",
)
def join_semi_both_ends(t: Tables) -> DataFrame:
    return restrict_to(t.trips, t.areas.filter("STATEFP = 1"), ["h_tract", "w_tract"])


@query(
    "join_semi_reverse",
    "SELECT * FROM blocks WHERE GEOID IN (SELECT h_geocode FROM flows_pair) AND GEOID IN (SELECT w_geocode FROM flows_pair)",
)
def join_semi_reverse(t: Tables) -> DataFrame:
    return active_areas(t.blocks, t.flows_pair, "h_geocode", "w_geocode")


@query("join_anti", "SELECT * FROM blocks WHERE GEOID NOT IN (SELECT w_geocode FROM flows_pair)")
def join_anti(t: Tables) -> DataFrame:
    return join(t.blocks, t.flows_pair, {"GEOID": "w_geocode"}, "anti")


@query(
    "join_natural",
    "SELECT h_tract, w_tract, f.commuters, n FROM flows_area f JOIN (SELECT h_tract, w_tract, count(*) AS n FROM trips GROUP BY ALL) m"
    " USING (h_tract, w_tract)",
)
def join_natural(t: Tables) -> DataFrame:
    counts = t.trips.groupBy("h_tract", "w_tract").agg(F.count(F.lit(1)).alias("n"))
    return join(t.flows_area, counts, how="inner")


@query(
    "join_filtered_right",
    "SELECT * FROM areas WHERE GEOID IN (SELECT w_tract FROM flows_area WHERE h_tract = 7)",
)
def join_filtered_right(t: Tables) -> DataFrame:
    return destinations_of(t.flows_area, t.areas, 7, "h_tract", "w_tract")


@query(
    "join_suffix",
    'SELECT c_nationkey AS GEOID, c_name AS NAME, n_name AS "NAME.1", c_custkey AS code FROM customer JOIN nation ON c_nationkey = n_nationkey',
)
def join_suffix(t: Tables) -> DataFrame:
    people = t.customer.select(F.col("c_nationkey").alias("GEOID"), F.col("c_name").alias("NAME"), F.col("c_custkey").alias("code"))
    return join(people, t.areas.select("GEOID", "NAME"), "GEOID", "inner", suffix=("", ".1"))


@query(
    "bind_columns",
    "SELECT o_orderkey, o_totalprice, n, CAST(q AS BIGINT) AS q FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n,"
    " sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey",
)
def bind_columns(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q")
    )
    return attach(t.orders.select("o_orderkey", "o_totalprice"), lines, {"o_orderkey": "l_orderkey"})


_TOP_ENDS = (
    "WITH top AS (SELECT * FROM flows_area ORDER BY commuters DESC, h_tract, w_tract LIMIT 10),"
    " ends AS (SELECT h_tract AS GEOID FROM top UNION SELECT w_tract FROM top),"
    " places AS (SELECT GEOID, n_nationkey * CAST(3 AS DOUBLE) - 100 AS lon, n_regionkey * CAST(4 AS DOUBLE) + 20 AS lat"
    " FROM ends JOIN nation ON GEOID = n_nationkey)"
)
_KM = (
    "round(2 * CAST(6371 AS DOUBLE) * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) *"
    " cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3)"
)


def _places(t: Tables) -> DataFrame:
    """Ends of the ten largest flows with a position."""
    ends = endpoints(top_k(t.flows_area, ["-commuters", "h_tract", "w_tract"], 10), ["h_tract", "w_tract"])
    spots = t.nation.select(
        F.col("n_nationkey").alias("GEOID"), (F.col("n_nationkey") * 3.0 - 100).alias("lon"), (F.col("n_regionkey") * 4.0 + 20).alias("lat")
    )
    return join(ends, spots, "GEOID", "inner", "never")


@query(
    "cross_pairs",
    f'{_TOP_ENDS} SELECT a.GEOID AS "origin_GEOID", b.GEOID AS "destination_GEOID", {_KM} AS travel_km FROM places a, places b',
)
def cross_pairs(t: Tables) -> DataFrame:
    return od_matrix(_places(t)).withColumn("travel_km", F.round("travel_km", 3))


@query(
    "pairs_to_one",
    f"{_TOP_ENDS} SELECT a.GEOID, a.lon, a.lat, {_KM} AS travel_km FROM places a, (SELECT CAST(-40 AS DOUBLE) AS lon, max(CAST(n_regionkey AS DOUBLE)) * 4 + 20 AS lat FROM nation) b",
)
def pairs_to_one(t: Tables) -> DataFrame:
    dest = t.nation.agg(F.lit(-40.0).alias("lon"), (F.max("n_regionkey") * 4.0 + 20).alias("lat"))
    return to_destination(_places(t), dest).withColumn("travel_km", F.round("travel_km", 3))


@query(
    "cross_pairs_network",
    "WITH RECURSIVE lines AS (SELECT o_custkey AS a, l_suppkey AS b, CAST(l_quantity AS BIGINT) AS step FROM lineitem"
    " JOIN orders ON l_orderkey = o_orderkey), roads AS (SELECT a, b, min(step) AS step FROM"
    " (SELECT * FROM lines UNION ALL SELECT b, a, step FROM lines) u WHERE a <> b GROUP BY 1, 2),"
    " top AS (SELECT * FROM flows_pair ORDER BY commuters DESC, h_geocode, w_geocode LIMIT 10),"
    " places AS (SELECT h_geocode AS name FROM top UNION SELECT w_geocode FROM top),"
    " best(origin, node, cost) USING KEY (origin, node) AS (SELECT name, name, CAST(0 AS BIGINT) FROM places UNION"
    " SELECT w.origin, w.node, w.cost FROM (SELECT f.origin, b AS node, min(f.cost + step) AS cost FROM best f"
    " JOIN roads ON f.node = a GROUP BY 1, 2) w LEFT JOIN recurring.best k ON k.origin = w.origin AND k.node = w.node"
    " WHERE k.cost IS NULL OR w.cost < k.cost)"
    " SELECT o.name AS origin_name, d.name AS destination_name, cost AS travel_cost FROM places o CROSS JOIN places d"
    " LEFT JOIN best ON origin = o.name AND node = d.name",
)
def cross_pairs_network(t: Tables) -> DataFrame:
    """Cheapest ways over all trips, between the ends of the ten largest flows."""
    trips = materialize(t.flows_block)
    pairs = sum_by(trips, ["h_geocode", "w_geocode"], "S000", out="commuters")
    ends = endpoints(top_k(pairs, ["-commuters", "h_geocode", "w_geocode"], 10), ["h_geocode", "w_geocode"], "name")
    return network_matrix(trips, ends, src="h_geocode", dst="w_geocode", cost="S000", both_ways=True)
