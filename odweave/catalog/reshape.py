"""Long and wide forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.functions.text import str_detect
from odweave.operators import reshape as r
from odweave.operators.verbs import arrange, cols_contains


@query(
    "unpivot",
    "SELECT commuters, tract_type, GEOID FROM (SELECT commuters, nullif(h_tract, 3) AS h_tract, w_tract FROM flows_area) q"
    " UNPIVOT INCLUDE NULLS (GEOID FOR tract_type IN (h_tract, w_tract))",
)
def unpivot(t: Tables) -> DataFrame:
    gaps = t.flows_area.withColumn("h_tract", F.nullif("h_tract", F.lit(3)))
    return r.unpivot(gaps, ["commuters"], cols_contains(gaps, "_tract"), "tract_type", "GEOID")


@query("unpivot_all", "SELECT h_geocode AS GEOID FROM flows_pair UNION SELECT w_geocode FROM flows_pair")
def unpivot_all(t: Tables) -> DataFrame:
    return r.endpoints(t.flows_pair, ["h_geocode", "w_geocode"])


_ROADS = {"red": "red", "small": "^small", "ring": "ring$"}


@query(
    "unpivot_flags",
    "SELECT h_tract, w_tract, l_linenumber, l_partkey, name, true AS value FROM (SELECT *, unnest(['red', 'small', 'ring']) AS name FROM steps_named) q"
    " WHERE CASE name WHEN 'red' THEN regexp_matches(instructions, 'red') WHEN 'small' THEN regexp_matches(instructions, '^small')"
    " ELSE regexp_matches(instructions, 'ring$') END",
)
def unpivot_flags(t: Tables) -> DataFrame:
    flagged = t.steps_named.withColumns({f"uses_{n}": str_detect("instructions", p) for n, p in _ROADS.items()})
    ids = ["h_tract", "w_tract", "l_linenumber", "l_partkey"]
    return r.flags_to_rows(flagged, cols_contains(flagged, "uses_"), ids, prefix="uses_")


_ENDS = (
    "(SELECT 'h_tract' AS name, h_tract AS value, duration FROM trips UNION ALL SELECT 'w_tract', w_tract, duration FROM trips) e"
)


@query("endpoint_mean", f"SELECT name, value, avg(duration) AS avg_duration FROM {_ENDS} GROUP BY ALL")
def endpoint_mean(t: Tables) -> DataFrame:
    return r.endpoint_mean(t.trips, "h_tract", "w_tract", "duration")


@query(
    "pivot_wide",
    "SELECT value, coalesce(avg(duration) FILTER (name = 'h_tract'), 0) AS h_tract,"
    " coalesce(avg(duration) FILTER (name = 'w_tract'), 0) AS w_tract FROM"
    " (SELECT 'h_tract' AS name, h_geocode AS value, S000 AS duration FROM flows_block UNION ALL SELECT 'w_tract', w_geocode, S000 FROM flows_block) e GROUP BY 1",
)
def pivot_wide(t: Tables) -> DataFrame:
    flows = t.flows_block.toDF("h_tract", "w_tract", "duration")
    means = r.endpoint_mean(flows, "h_tract", "w_tract", "duration")
    return r.pivot(means, ["value"], "name", "avg_duration", ["h_tract", "w_tract"], fill=0.0)


@query(
    "complete_grid",
    "WITH b AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)"
    " SELECT c.o_custkey, s.o_orderstatus, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_custkey FROM b) c"
    " CROSS JOIN (SELECT DISTINCT o_orderstatus FROM b) s LEFT JOIN b ON b.o_custkey = c.o_custkey AND b.o_orderstatus = s.o_orderstatus",
)
def complete_grid(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return r.complete(counts, ["o_custkey", "o_orderstatus"], {"n": 0})


@query(
    "role_panel",
    "SELECT GEOID, blocks.NAME AS area_name, segment, q.name, CAST(name_ord AS INTEGER) AS name_ord, avg_duration FROM blocks,"
    " (VALUES ('h', 'Origin tract', 0), ('w', 'Destination tract', 1)) q(role, name, name_ord) LEFT JOIN"
    " (SELECT 'h' AS role, h_geocode AS area, avg(S000) AS avg_duration FROM flows_block GROUP BY 2"
    " UNION ALL SELECT 'w', w_geocode, avg(S000) FROM flows_block GROUP BY 2) m ON m.role = q.role AND m.area = GEOID",
)
def role_panel(t: Tables) -> DataFrame:
    blocks = t.blocks.withColumnRenamed("NAME", "area_name")
    flows = t.flows_block.toDF("h_tract", "w_tract", "duration")
    return r.role_panel(blocks, flows, "h_tract", "w_tract", "duration")


@query("uncount", "SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, unnest(range(CAST(l_quantity AS BIGINT))) FROM lineitem) q")
def uncount(t: Tables) -> DataFrame:
    return r.uncount(t.lineitem.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("w")), "w")


@query(
    "unnest_steps",
    "SELECT o_custkey AS h_tract, o_orderkey AS w_tract, step, step * CAST(floor(o_totalprice / 10000) AS BIGINT) AS duration FROM orders,"
    " LATERAL (SELECT unnest(range(1, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 1)) AS step) s WHERE o_orderstatus <> 'P'"
    " UNION ALL SELECT o_custkey, o_orderkey, NULL, NULL FROM orders WHERE o_orderstatus = 'P'",
)
def unnest_steps(t: Tables) -> DataFrame:
    return r.unnest(t.route_nested, "directions", keep_empty=True).drop("commuters")


@query(
    "unnest_metrics",
    "SELECT h_tract, w_tract, 'duration' AS metric, CAST(duration AS DOUBLE) AS estimate FROM routes UNION ALL"
    " SELECT h_tract, w_tract, 'steps', CAST(steps AS DOUBLE) FROM routes",
)
def unnest_metrics(t: Tables) -> DataFrame:
    item = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("estimate")) for m in ("duration", "steps")]
    nested = t.routes.select("h_tract", "w_tract", F.array(*item).alias("metrics"))
    return arrange(r.unnest(nested, "metrics"), "metric")


@query(
    "row_names_to_column",
    "SELECT CAST(c_nationkey AS DOUBLE) AS origin_id, CAST(s_regionkey AS DOUBLE) AS destination_id, CAST(sum(commuters) AS BIGINT) AS travel_time"
    " FROM (SELECT h_tract AS c_nationkey, n_regionkey AS s_regionkey, commuters FROM flows_area JOIN nation ON w_tract = n_nationkey) q GROUP BY 1, 2",
)
def row_names_to_column(t: Tables) -> DataFrame:
    to_region = t.flows_area.join(t.nation, F.col("w_tract") == F.col("n_nationkey"))
    regions = [str(x["r_regionkey"]) for x in t.region.select("r_regionkey").collect()]
    sums = to_region.groupBy("h_tract", F.concat(F.lit("V"), F.col("n_regionkey").cast("string")).alias("v")).agg(
        F.sum("commuters").alias("n")
    )
    matrix = r.pivot(sums, ["h_tract"], "v", "n", [f"V{x}" for x in regions])
    matrix = matrix.withColumnRenamed("h_tract", "origin_id").withColumn("origin_id", F.col("origin_id").cast("string"))
    return r.matrix_to_long(matrix, "V", "origin_id", "destination_id", "travel_time")


