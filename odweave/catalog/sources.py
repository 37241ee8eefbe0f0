"""Scans and sinks: tables are written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.operators.enrichment import split_failures
from odweave.operators.joins import join
from odweave.operators.verbs import rename_map
from odweave.plans.flow_map import flow_map
from odweave.sources.areas import read_areas, read_water
from odweave.sources.flows import read_flows
from odweave.sources.tables import read_flow_bundle, read_table, read_text_table, write_failures, write_table

_CODES = (
    "SELECT lpad(CAST(h_geocode AS VARCHAR), 15, '0') AS h_geocode, lpad(CAST(w_geocode AS VARCHAR), 15, '0') AS w_geocode,"
    " CAST(S000 AS VARCHAR) AS S000 FROM flows_block"
)


def _coded(t: Tables) -> DataFrame:
    code = [F.lpad(F.col(c).cast("string"), 15, "0").alias(c) for c in ("h_geocode", "w_geocode")]
    return t.flows_block.select(*code, F.col("S000").cast("string").alias("S000"))


@query("scan_text", _CODES)
def scan_text(t: Tables) -> DataFrame:
    path = t.scratch("scan_text")
    write_table(_coded(t), path, "csv", "overwrite", compression="gzip")
    return read_text_table(t.spark, path, ["h_geocode", "w_geocode", "S000"])


@query(
    "scan_text_multi",
    "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_linestatus FROM lineitem",
)
def scan_text_multi(t: Tables) -> DataFrame:
    path = t.scratch("scan_text_multi")
    cols = ["l_orderkey", "l_linenumber", "l_linestatus"]
    lines = t.lineitem.select(*cols, F.col("l_returnflag").alias("part"))
    write_table(lines, path, "csv", "overwrite", partition_by=["part"], compression="gzip")
    return read_text_table(t.spark, f"{path}/part=*", cols)


@query("scan_head", "SELECT count(*) AS n FROM (SELECT * FROM flows_block LIMIT 2500) q")
def scan_head(t: Tables) -> DataFrame:
    path = t.scratch("scan_head")
    write_table(_coded(t), path, "csv", "overwrite")
    return read_text_table(t.spark, path, n_max=2_500).agg(F.count(F.lit(1)).alias("n"))


@query("scan_typed", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def scan_typed(t: Tables) -> DataFrame:
    path = t.scratch("scan_typed")
    write_table(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), path, "csv", "overwrite")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"
    return read_table(t.spark, path, schema, "csv")


@query("scan_intermediate", "SELECT * FROM routes")
def scan_intermediate(t: Tables) -> DataFrame:
    path = t.scratch("scan_intermediate")
    write_table(t.routes, path, mode="overwrite")
    return read_table(t.spark, path).withColumn("distance", F.col("distance").cast("double"))


@query(
    "scan_flows",
    'SELECT state, substr(w_geocode, 1, 5) AS w_county, substr(h_geocode, 1, 5) AS h_county, CAST(sum(S000) AS BIGINT) AS "S000",'
    " 2017 AS year, part FROM county_flows GROUP BY ALL",
)
def scan_flows(t: Tables) -> DataFrame:
    path = t.scratch("scan_flows")
    named = t.county_flows.select(
        "w_geocode", "h_geocode", "S000", F.concat("state", F.lit("_od_"), "part", F.lit("_JT00_2017.csv.gz")).alias("file")
    )
    dealt = named.repartition("file", F.pmod(F.hash("h_geocode"), F.lit(4)))  # a few files per state, not one per task
    write_table(dealt, path, "csv", "overwrite", partition_by=["file"], compression="gzip")
    states = [r["s"] for r in t.region.select(F.lower(F.regexp_replace("r_name", " ", "")).alias("s")).collect()]
    return read_flows(t.spark, path, states, 2017, ("main", "aux"), agg_geo="county")


@query(
    "scan_areas",
    "SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS GEOID, c_name AS NAME,"
    " CAST(floor(c_acctbal) AS BIGINT) AS total_pop, CAST(length(c_mktsegment) AS BIGINT) AS housing FROM customer",
)
def scan_areas(t: Tables) -> DataFrame:
    path = t.scratch("scan_areas")
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    values = F.array(
        F.struct(F.lit("P001001").alias("variable"), F.floor("c_acctbal").cast("bigint").alias("value")),
        F.struct(F.lit("H001001").alias("variable"), F.length("c_mktsegment").cast("bigint").alias("value")),
    )
    write_table(t.customer.select(code.alias("GEOID"), F.col("c_name").alias("NAME"), F.inline(values)), path, mode="overwrite")
    return read_areas(t.spark, path, level="tract", variables={"total_pop": "P001001", "housing": "H001001"})


@query("scan_water", "SELECT FULLNAME, AWATER FROM water")
def scan_water(t: Tables) -> DataFrame:
    path = t.scratch("scan_water")
    write_table(t.water, path, mode="overwrite")
    return read_water(t.spark, path).drop("geometry")


@query(
    "scan_routes_renamed",
    "SELECT h_tract, home_address, w_tract, work_address, duration, CAST(distance AS DOUBLE) AS distance, commuters FROM steps",
)
def scan_routes_renamed(t: Tables) -> DataFrame:
    path = t.scratch("scan_routes_renamed")
    # fixed values: route columns cut to ten characters, and their full names
    names = {"hm_ddrs": "home_address", "wrk_ddr": "work_address", "duratin": "duration", "distanc": "distance", "commtrs": "commuters"}
    cut = t.steps.select(
        "h_tract", F.col("home_address").alias("hm_ddrs"), "w_tract", F.col("work_address").alias("wrk_ddr"),
        F.col("duration").alias("duratin"), F.col("distance").cast("double").alias("distanc"), F.col("commuters").alias("commtrs"),
    )
    write_table(cut, path, mode="overwrite")
    return rename_map(read_table(t.spark, path), names)


@query("sink_csv", "SELECT * FROM flows_pair")
def sink_csv(t: Tables) -> DataFrame:
    path = t.scratch("sink_csv")
    write_table(t.flows_pair, path, "csv", "overwrite")
    return read_table(t.spark, path, "h_geocode bigint, w_geocode bigint, commuters bigint", "csv")


@query("sink_overwrite", "SELECT * FROM flows_area")
def sink_overwrite(t: Tables) -> DataFrame:
    path = t.scratch("sink_overwrite")
    write_table(t.flows_pair, path, mode="overwrite")
    write_table(t.flows_area, path, mode="overwrite")
    return read_table(t.spark, path)


@query("sink_bad_rows", "SELECT o_custkey AS h_tract, o_orderkey AS w_tract FROM orders WHERE o_orderstatus = 'P'")
def sink_bad_rows(t: Tables) -> DataFrame:
    path = t.scratch("sink_bad_rows")
    calls = t.orders.select(
        F.col("o_custkey").alias("h_tract"), F.col("o_orderkey").alias("w_tract"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("directions"),
    )
    _, bad = split_failures(calls, "directions", ["h_tract", "w_tract"])
    write_failures(bad, path)
    return read_table(t.spark, path, "h_tract bigint, w_tract bigint", "csv")


@query(
    "sink_flow_bundle",
    "WITH c AS (SELECT substr(h_geocode, 1, 2) || '000' AS h, substr(w_geocode, 1, 2) || '000' AS w, part,"
    " CAST(sum(S000) AS BIGINT) AS n FROM county_flows GROUP BY ALL)"
    " SELECT a.NAME || ' County, ' || sa.state_name AS origin_name, b.NAME || ' County, ' || sb.state_name AS dest_name, n AS count"
    " FROM c JOIN counties a ON h = a.GEOID JOIN states sa ON a.STATEFP = sa.state_code"
    " JOIN counties b ON w = b.GEOID JOIN states sb ON b.STATEFP = sb.state_code WHERE n >= 500",
)
def sink_flow_bundle(t: Tables) -> DataFrame:
    path = t.scratch("sink_flow_bundle")
    coarse = t.county_flows.select(
        "part", "S000",
        *[F.concat(F.substring(f"{e}_geocode", 1, 2), F.lit("000")).alias(f"{e}_county") for e in "hw"],
    )
    flows = coarse.groupBy("part", "h_county", "w_county").agg(F.sum("S000").alias("commuters"))
    out = flow_map(flows.filter("part = 'main'"), flows.filter("part = 'aux'"), t.counties, t.states)
    out.write(path, {"title": "Commuter flow", "clustering": "yes", "mapbox.mapStyle": None})
    edges, places = (read_flow_bundle(t.spark, path, name) for name in ("flows", "locations"))
    for end in ("origin", "dest"):
        names = places.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
        edges = join(edges, names, end, na_matches="never")
    return edges.select("origin_name", "dest_name", "count")


