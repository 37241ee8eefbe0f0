"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.functions import text as x
from odweave.functions.geometry import xy
from odweave.functions.semantics import try_num
from odweave.operators.reshape import level_order
from odweave.operators.stats import scale_rms


@query("str_prefix", "SELECT o_orderkey, substr(o_orderpriority, 1, 3) AS code FROM orders")
def str_prefix(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", x.area_prefix("o_orderpriority", 3).alias("code"))


@query(
    "str_concat",
    "SELECT o_orderkey, 'h_tract: ' || CAST(o_custkey AS VARCHAR) || ', ' || nullif(o_orderstatus, 'P') AS od_id FROM orders",
)
def str_concat(t: Tables) -> DataFrame:
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.select("o_orderkey", x.str_c("h_tract: ", F.col("o_custkey").cast("string"), ", ", status).alias("od_id"))


@query("str_detect", "SELECT p_partkey, regexp_matches(p_name, '(red|blue) w') AS hit FROM part")
def str_detect(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", x.str_detect("p_name", "(red|blue) w").alias("hit"))


@query("str_remove", "SELECT page_id, regexp_replace(url, '[a-z]+', '') AS url FROM pages")
def str_remove(t: Tables) -> DataFrame:
    return t.pages.select("page_id", x.str_remove("url", "[a-z]+").alias("url"))


@query("str_replace", "SELECT doc_id, regexp_replace(text, '[aeiou]+', 'I ') AS text FROM documents")
def str_replace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.str_replace("text", "[aeiou]+", "I ").alias("text"))


@query(
    "case_when",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'Centre' WHEN l_returnflag = 'R' THEN 'East side' END AS name FROM lineitem",
)
def case_when(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    name = x.case_when((flag == "A", F.lit("Centre")), (flag == "R", F.lit("East side")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", name.alias("name"))


@query(
    "patch_value",
    "SELECT l_orderkey, l_suppkey, CASE WHEN l_suppkey = 7 THEN 'patched' WHEN l_suppkey <> 7 THEN l_linestatus END AS l_linestatus FROM lineitem",
)
def patch_value(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_suppkey", x.patch_value("l_suppkey", 7, "l_linestatus", "patched").alias("l_linestatus"))


@query(
    "num_parse",
    "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, TRY_CAST(o_orderpriority AS BIGINT) AS bad,"
    " CAST(o_custkey AS VARCHAR) AS code FROM orders",
)
def num_parse(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        try_num(F.substring("o_orderpriority", 1, 1), "bigint").alias("level"),
        try_num("o_orderpriority", "bigint").alias("bad"),
        F.col("o_custkey").cast("string").alias("code"),
    )


@query("num_extract", "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '[0-9]+', 0) AS DOUBLE) AS n FROM part")
def num_extract(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", x.parse_number("p_brand").alias("n"))


@query(
    "num_round",
    "SELECT l_orderkey, l_partkey, CAST(round_even(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS price FROM lineitem",
)
def num_round(t: Tables) -> DataFrame:
    price = x.round_half_even(F.col("l_extendedprice").cast("decimal(18,2)"), 1).cast("double")
    return t.lineitem.select("l_orderkey", "l_partkey", price.alias("price"))


@query(
    "num_scale_rms",
    "SELECT h_geocode, w_geocode, commuters, round(commuters / sqrt((SELECT sum(commuters * commuters) / (count(commuters) - 1) FROM flows_pair)) * 3, 9)"
    " AS commuters_scaled FROM flows_pair",
)
def num_scale_rms(t: Tables) -> DataFrame:
    return scale_rms(t.flows_pair, "commuters", 3.0).withColumn("commuters_scaled", F.round("commuters_scaled", 9))


@query(
    "arith",
    "SELECT h_geocode, w_geocode, commuters - h_geocode AS diff, CAST(commuters AS DOUBLE) / nullif(w_geocode, 0) AS ratio FROM flows_pair",
)
def arith(t: Tables) -> DataFrame:
    return t.flows_pair.select(
        "h_geocode", "w_geocode", (F.col("commuters") - F.col("h_geocode")).alias("diff"),
        F.try_divide(F.col("commuters").cast("double"), F.col("w_geocode").cast("double")).alias("ratio"),
    )


@query("bool_flag", "SELECT *, h_tract = w_tract AS intra_tract_commute FROM trips")
def bool_flag(t: Tables) -> DataFrame:
    return t.trips.withColumn("intra_tract_commute", F.col("h_tract") == F.col("w_tract"))


@query(
    "fmt_label",
    "SELECT h_tract, w_tract, format('Home tract: {}, steps: {:05d}, status {}', h_tract, steps, work_address) AS label FROM routes",
)
def fmt_label(t: Tables) -> DataFrame:
    label = x.format_label("Home tract: %d, steps: %05d, status %s", ["h_tract", "steps", "work_address"])
    return t.routes.select("h_tract", "w_tract", label.alias("label"))


@query(
    "factor_rev",
    "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority DESC) AS o_orderpriority_ord FROM orders",
)
def factor_rev(t: Tables) -> DataFrame:
    return level_order(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", reverse=True)


@query(
    "factor_reorder",
    "WITH m AS (SELECT h_geocode, row_number() OVER (ORDER BY median(commuters), h_geocode) AS h_geocode_ord FROM flows_pair GROUP BY 1)"
    " SELECT h_geocode, w_geocode, commuters, h_geocode_ord FROM flows_pair JOIN m USING (h_geocode)",
)
def factor_reorder(t: Tables) -> DataFrame:
    return level_order(t.flows_pair, "h_geocode", by="commuters")


@query("first_elem", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings")
def first_elem(t: Tables) -> DataFrame:
    at = t.embeddings.select("vec_id", F.struct(*[F.col("embedding").getItem(i).cast("double").alias(n) for i, n in enumerate("xy")]).alias("g"))
    lon, lat = xy("g")
    return at.select("vec_id", lon.alias("lon"), lat.alias("lat"))
