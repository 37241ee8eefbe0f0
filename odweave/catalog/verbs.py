"""Projections, filters, predicates, stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.functions.text import str_detect
from odweave.operators import verbs as v
from odweave.operators.joins import join
from odweave.operators.windows import cumulative_share


@query("project", "SELECT w_geocode, commuters FROM flows_pair")
def project(t: Tables) -> DataFrame:
    return t.flows_pair.select("w_geocode", "commuters")


@query("project_drop", "SELECT l_orderkey, l_quantity FROM lineitem")
def project_drop(t: Tables) -> DataFrame:
    return t.lineitem.drop(*[c for c in t.lineitem.columns if c not in ("l_orderkey", "l_quantity")])


@query("project_helpers", "SELECT h_tract, w_tract, home_address, work_address, duration FROM steps")
def project_helpers(t: Tables) -> DataFrame:
    s = t.steps
    cols = [*v.cols_contains(s, "TRACT"), *v.cols_matches(s, "_addr"), *v.cols_starts_with(s, "dur")]
    return v.move_first(s.select(*cols), "duration")


@query("rename", "SELECT h_geocode AS origin, w_geocode AS dest, commuters AS count FROM flows_pair")
def rename(t: Tables) -> DataFrame:
    return v.rename_map(t.flows_pair, {"h_geocode": "origin", "w_geocode": "dest", "commuters": "count"})


@query(
    "derive",
    "SELECT h_geocode, w_geocode, commuters, commuters * 2 AS both_ways, commuters * 2 + 1 AS plus_one FROM flows_pair",
)
def derive(t: Tables) -> DataFrame:
    return v.mutate(t.flows_pair, [("both_ways", F.col("commuters") * 2), ("plus_one", F.col("both_ways") + 1)])


@query(
    "scalar_extract",
    "SELECT h_geocode, w_geocode, commuters, commuters / (SELECT max(commuters) FROM flows_pair) AS of_max FROM flows_pair",
)
def scalar_extract(t: Tables) -> DataFrame:
    top = v.scalar(t.flows_pair.agg(F.max("commuters").alias("m")), "m")
    return t.flows_pair.withColumn("of_max", F.col("commuters") / top)


@query("filter_threshold_gt", "SELECT * FROM flows_pair WHERE commuters > 25")
def filter_threshold_gt(t: Tables) -> DataFrame:
    return v.min_flow(t.flows_pair, "commuters", 25)


@query("filter_threshold_ge", "SELECT * FROM flows_area WHERE commuters >= 500")
def filter_threshold_ge(t: Tables) -> DataFrame:
    return v.min_flow(t.flows_area, "commuters", 500, inclusive=True)


@query("filter_no_self", "SELECT * FROM flows_area WHERE NOT (h_tract = w_tract)")
def filter_no_self(t: Tables) -> DataFrame:
    return v.drop_self_flows(t.flows_area, "h_tract", "w_tract")


@query("filter_eq", "SELECT * FROM flows_area WHERE h_tract = 3")
def filter_eq(t: Tables) -> DataFrame:
    return t.flows_area.filter(F.col("h_tract") == 3)


@query("filter_ne", "SELECT * FROM trips WHERE w_tract <> 3")
def filter_ne(t: Tables) -> DataFrame:
    return t.trips.filter(F.col("w_tract") != 3)


@query(
    "filter_in",
    "SELECT * FROM flows_pair WHERE h_geocode IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def filter_in(t: Tables) -> DataFrame:
    ids = t.customer.filter("c_acctbal > 0").select("c_custkey")
    return join(t.flows_pair, ids, {"h_geocode": "c_custkey"}, "semi", "never")


@query(
    "filter_null",
    "SELECT GEOID, NAME FROM blocks LEFT JOIN (SELECT w_geocode, sum(commuters) AS n FROM flows_pair GROUP BY 1) f"
    " ON GEOID = w_geocode WHERE n IS NULL",
)
def filter_null(t: Tables) -> DataFrame:
    flows = t.flows_pair.groupBy("w_geocode").agg(F.sum("commuters").alias("n"))
    return join(t.blocks, flows, {"GEOID": "w_geocode"}, na_matches="never").filter(F.col("n").isNull()).select("GEOID", "NAME")


@query(
    "filter_not_null",
    "SELECT GEOID, CAST(n AS BIGINT) AS n FROM blocks LEFT JOIN (SELECT w_geocode, sum(commuters) AS n FROM flows_pair"
    " GROUP BY 1) f ON GEOID = w_geocode WHERE n IS NOT NULL",
)
def filter_not_null(t: Tables) -> DataFrame:
    flows = t.flows_pair.groupBy("w_geocode").agg(F.sum("commuters").alias("n"))
    return join(t.blocks, flows, {"GEOID": "w_geocode"}, na_matches="never").filter(F.col("n").isNotNull()).select("GEOID", "n")


@query(
    "filter_band",
    "WITH r AS (SELECT *, row_number() OVER w AS id, sum(commuters) OVER w / (SELECT sum(commuters) FROM flows_pair) AS p"
    " FROM flows_pair WINDOW w AS (ORDER BY commuters DESC, h_geocode, w_geocode ROWS UNBOUNDED PRECEDING))"
    " SELECT h_geocode, w_geocode, commuters, id FROM r WHERE p <= 0.2 AND p > 0.199",
)
def filter_band(t: Tables) -> DataFrame:
    ranked = cumulative_share(t.flows_pair, "commuters", ["h_geocode", "w_geocode"])
    share = F.col("cumulative_pct_commuters")
    return ranked.filter((share <= 0.2) & (share > 0.199)).select("h_geocode", "w_geocode", "commuters", "id")


@query(
    "filter_regex",
    "SELECT h_tract, w_tract, instructions FROM steps_named WHERE regexp_matches(instructions, 'red|small (ring|widget)')",
)
def filter_regex(t: Tables) -> DataFrame:
    return t.steps_named.filter(str_detect("instructions", "red|small (ring|widget)")).select("h_tract", "w_tract", "instructions")


_WITH_GAPS = "SELECT h_geocode, w_geocode, nullif(commuters, 50) AS commuters FROM flows_pair"


@query("drop_incomplete", f"SELECT * FROM ({_WITH_GAPS}) q WHERE commuters IS NOT NULL")
def drop_incomplete(t: Tables) -> DataFrame:
    gaps = t.flows_pair.withColumn("commuters", F.nullif("commuters", F.lit(50)))
    return v.drop_incomplete(gaps)


@query(
    "fill_null",
    "SELECT GEOID, coalesce(commuters_in, 0) AS commuters_in, commuters_out FROM blocks"
    " LEFT JOIN (SELECT w_geocode, CAST(sum(commuters) AS BIGINT) AS commuters_in FROM flows_pair GROUP BY 1) a ON GEOID = w_geocode"
    " LEFT JOIN (SELECT h_geocode, CAST(sum(commuters) AS BIGINT) AS commuters_out FROM flows_pair GROUP BY 1) b ON GEOID = h_geocode",
)
def fill_null(t: Tables) -> DataFrame:
    flows_in = t.flows_pair.groupBy("w_geocode").agg(F.sum("commuters").alias("commuters_in"))
    flows_out = t.flows_pair.groupBy("h_geocode").agg(F.sum("commuters").alias("commuters_out"))
    both = join(t.blocks.select("GEOID"), flows_in, {"GEOID": "w_geocode"}, na_matches="never")
    both = join(both, flows_out, {"GEOID": "h_geocode"}, na_matches="never")
    return v.fill_null(both, {"commuters_in": 0})


@query("distinct_rows", "SELECT DISTINCT h_tract, w_tract, duration FROM trips")
def distinct_rows(t: Tables) -> DataFrame:
    return t.trips.select("h_tract", "w_tract", "duration").distinct()


@query("distinct_cols", "SELECT DISTINCT w_tract, commuters FROM trips")
def distinct_cols(t: Tables) -> DataFrame:
    return v.distinct_keys(t.trips, ["w_tract", "commuters"])


@query(
    "lookup_map",
    "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS value FROM orders",
)
def lookup_map(t: Tables) -> DataFrame:
    return v.lookup_map(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "done", "O": "open"})


@query(
    "union_all",
    "SELECT o_custkey AS area, 'home' AS role, o_totalprice AS amount FROM orders"
    " UNION ALL SELECT l_suppkey, 'work', NULL FROM lineitem",
)
def union_all(t: Tables) -> DataFrame:
    home = t.orders.select(F.col("o_custkey").alias("area"), F.lit("home").alias("role"), F.col("o_totalprice").alias("amount"))
    work = t.lineitem.select(F.lit("work").alias("role"), F.col("l_suppkey").alias("area"))
    return v.union_by_name(home, work)


@query(
    "replace_rows",
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'retried' ELSE 'main' END AS source_file FROM orders",
)
def replace_rows(t: Tables) -> DataFrame:
    main = v.with_source(t.orders.select("o_orderkey", "o_custkey"), "main")
    retried = v.with_source(t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey"), "retried")
    return v.replace_rows(main, retried, ["o_orderkey"])


@query("tag_source", "SELECT h_geocode, w_geocode, 'main' AS source_file FROM flows_pair")
def tag_source(t: Tables) -> DataFrame:
    return v.with_source(t.flows_pair.select("h_geocode", "w_geocode"), "main")
