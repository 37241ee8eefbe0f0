"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import ROUTE, Tables
from odweave.catalog.registry import query
from odweave.functions.semantics import single_value
from odweave.operators import aggregates as a
from odweave.operators.verbs import distinct_keys
from odweave.operators.windows import share_buckets, weighted_median

_SUM = "CASE WHEN count({c}) = count(*) THEN CAST(sum({c}) AS BIGINT) END"
_GAPS = "(SELECT h_tract, w_tract, nullif(duration, 50) AS duration, commuters FROM trips) g"


def _gaps(t: Tables) -> DataFrame:
    return t.trips.withColumn("duration", F.nullif("duration", F.lit(50)))


@query("agg_sum", f"SELECT h_tract, w_tract, {_SUM.format(c='duration')} AS duration FROM {_GAPS} GROUP BY ALL")
def agg_sum(t: Tables) -> DataFrame:
    return a.sum_by(_gaps(t), ["h_tract", "w_tract"], "duration")


@query(
    "agg_sum_narm",
    "SELECT h_tract, w_tract, CAST(round_even(CAST(coalesce(sum(nullif(distance, 100.25)), 0) AS DECIMAL(28,2)), 1) AS DOUBLE) AS distance FROM steps GROUP BY ALL",
)
def agg_sum_narm(t: Tables) -> DataFrame:
    gaps = t.steps.withColumn("distance", F.nullif("distance", F.lit(100.25).cast("decimal(18,2)")))
    out = a.sum_by(gaps, ["h_tract", "w_tract"], "distance", na_rm=True, digits=1)
    return out.withColumn("distance", F.col("distance").cast("double"))


@query("agg_two_level", "SELECT * FROM flows_area")
def agg_two_level(t: Tables) -> DataFrame:
    return t.flows_area


@query("agg_out", "SELECT h_geocode, CAST(sum(commuters) AS BIGINT) AS commuters_out FROM flows_pair GROUP BY 1")
def agg_out(t: Tables) -> DataFrame:
    return a.sum_by(t.flows_pair, ["h_geocode"], "commuters", out="commuters_out")


@query(
    "agg_in",
    "SELECT coalesce(i.area, o.area) AS area, commuters_out, commuters_in FROM"
    " (SELECT w_geocode AS area, CAST(sum(commuters) AS BIGINT) AS commuters_in FROM flows_pair GROUP BY 1) i FULL JOIN"
    " (SELECT h_geocode AS area, CAST(sum(commuters) AS BIGINT) AS commuters_out FROM flows_pair GROUP BY 1) o ON i.area = o.area",
)
def agg_in(t: Tables) -> DataFrame:
    return a.area_flows(t.flows_pair, "h_geocode", "w_geocode", "commuters")


@query(
    "net_flow",
    "SELECT GEOID, NAME, commuters_out, coalesce(commuters_in, 0) AS commuters_in, coalesce(commuters_in, 0) - commuters_out AS diff FROM blocks"
    " LEFT JOIN (SELECT w_geocode, CAST(sum(commuters) AS BIGINT) AS commuters_in FROM flows_pair GROUP BY 1) i ON GEOID = w_geocode"
    " LEFT JOIN (SELECT h_geocode, CAST(sum(commuters) AS BIGINT) AS commuters_out FROM flows_pair GROUP BY 1) o ON GEOID = h_geocode",
)
def net_flow(t: Tables) -> DataFrame:
    return a.net_flow(t.blocks.drop("segment"), t.flows_pair, "h_geocode", "w_geocode")


@query(
    "agg_mean",
    f"SELECT h_tract, w_tract, CASE WHEN count(duration) = count(*) THEN avg(duration) END AS mean_duration FROM {_GAPS} GROUP BY ALL",
)
def agg_mean(t: Tables) -> DataFrame:
    return a.mean_by(_gaps(t), ["h_tract", "w_tract"], "duration")


@query("agg_mean_narm", f"SELECT h_tract, w_tract, avg(duration) AS mean_duration FROM {_GAPS} GROUP BY ALL")
def agg_mean_narm(t: Tables) -> DataFrame:
    return a.mean_by(_gaps(t), ["h_tract", "w_tract"], "duration", na_rm=True)


@query("agg_count", "SELECT h_tract, w_tract, count(*) AS n FROM trips GROUP BY ALL")
def agg_count(t: Tables) -> DataFrame:
    return a.count_by(t.trips, ["h_tract", "w_tract"])


@query(
    "agg_n_in_summary",
    "SELECT h_tract, w_tract, CAST(sum(duration) AS BIGINT) AS duration, count(*) AS steps FROM steps GROUP BY ALL",
)
def agg_n_in_summary(t: Tables) -> DataFrame:
    return t.steps.groupBy("h_tract", "w_tract").agg(F.sum("duration").alias("duration"), F.count(F.lit(1)).alias("steps"))


@query("route_stats", "SELECT * FROM routes")
def route_stats(t: Tables) -> DataFrame:
    return t.routes.withColumn("distance", F.col("distance").cast("double"))


@query("agg_single_value", "SELECT w_tract, min(commuters) AS commuters FROM steps GROUP BY 1")
def agg_single_value(t: Tables) -> DataFrame:
    return t.steps.groupBy("w_tract").agg(single_value("commuters").alias("commuters"))


@query("agg_distinct_keys", "SELECT DISTINCT h_tract, home_address, w_tract, work_address FROM steps")
def agg_distinct_keys(t: Tables) -> DataFrame:
    return distinct_keys(t.steps, ROUTE)


@query("agg_global", "SELECT CAST(sum(commuters) AS BIGINT) AS commuters FROM routes")
def agg_global(t: Tables) -> DataFrame:
    return a.total(t.routes, "commuters")


@query(
    "agg_median_weighted",
    "SELECT median(duration) AS median FROM (SELECT duration, unnest(range(commuters)) FROM routes) q",
)
def agg_median_weighted(t: Tables) -> DataFrame:
    return weighted_median(t.routes, "duration", "commuters")


@query(
    "share_of_total",
    "SELECT h_tract = w_tract AS intra, CAST(sum(commuters) AS BIGINT) AS commuters,"
    " CAST(sum(commuters) AS DOUBLE) / (SELECT sum(commuters) FROM flows_area) AS pct_commuters FROM flows_area GROUP BY 1",
)
def share_of_total(t: Tables) -> DataFrame:
    flagged = t.flows_area.withColumn("intra", F.col("h_tract") == F.col("w_tract"))
    return a.add_share(a.sum_by(flagged, ["intra"], "commuters"), "commuters")


@query(
    "totals_row",
    "WITH s AS (SELECT CAST(h_tract = w_tract AS VARCHAR) AS intra, sum(commuters) AS n FROM flows_area GROUP BY 1)"
    " SELECT intra, CAST(n AS BIGINT) AS commuters FROM s UNION ALL SELECT 'Total', CAST(sum(n) AS BIGINT) FROM s",
)
def totals_row(t: Tables) -> DataFrame:
    flagged = t.flows_area.withColumn("intra", F.col("h_tract") == F.col("w_tract"))
    return a.with_totals(a.sum_by(flagged, ["intra"], "commuters"), "intra")


@query(
    "bucket_sum",
    "WITH r AS (SELECT commuters, sum(commuters) OVER (ORDER BY commuters DESC, h_geocode, w_geocode ROWS UNBOUNDED PRECEDING)"
    " / (SELECT sum(commuters) FROM flows_pair) AS p FROM flows_pair)"
    " SELECT CASE WHEN p <= 0.2 THEN 'Top 20%' ELSE 'Outside top 20%' END AS flag, CAST(sum(commuters) AS BIGINT) AS commuters FROM r GROUP BY 1",
)
def bucket_sum(t: Tables) -> DataFrame:
    return share_buckets(t.flows_pair, "commuters", 0.2, ("Top 20%", "Outside top 20%"), ["h_geocode", "w_geocode"])


@query(
    "agg_by_attribute",
    "SELECT segment, CASE WHEN count(n) = count(*) THEN CAST(sum(n) AS BIGINT) END AS commuters FROM blocks LEFT JOIN"
    " (SELECT h_geocode, sum(commuters) AS n FROM flows_pair GROUP BY 1) f ON GEOID = h_geocode GROUP BY 1",
)
def agg_by_attribute(t: Tables) -> DataFrame:
    return a.flows_by_name(t.blocks, t.flows_pair, "h_geocode", "segment", "commuters")
