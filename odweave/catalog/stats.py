"""Chart statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.operators import stats as s
from odweave.operators.aggregates import mean_by
from odweave.operators.joins import map_areas
from odweave.operators.reshape import tile_matrix
from odweave.operators.windows import cumulative_share

_HIST = (
    "WITH r AS (SELECT min(distance) AS lo, max(distance) AS hi FROM routes), w AS (SELECT lo, hi, (hi - lo) / 29 AS w FROM r),"
    " o AS (SELECT *, w / 2 + floor((lo - w / 2) / w) * w AS o FROM w),"
    " c AS (SELECT greatest(CAST(ceil((distance - o) / w) AS BIGINT) - 1, 0) AS bin, count(*) AS n FROM routes, o GROUP BY 1)"
    " SELECT b.bin, round(o + b.bin * w, 6) AS xmin, round(o + (b.bin + 1) * w, 6) AS xmax, coalesce(n, 0) AS count"
    " FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN o LEFT JOIN c ON c.bin = b.bin"
)


@query("histogram", _HIST)
def histogram(t: Tables) -> DataFrame:
    routes = t.routes.withColumn("distance", F.col("distance").cast("double"))
    return s.histogram(routes, "distance").withColumns({c: F.round(c, 6) for c in ("xmin", "xmax")})


_BAND = 2.0
_DENSITY = (
    "WITH r AS (SELECT CAST(min(duration) AS DOUBLE) AS lo, CAST(max(duration) AS DOUBLE) AS hi, (CAST(max(duration) AS DOUBLE) - min(duration)) / 1024 AS st FROM routes WHERE true),"
    " p AS (SELECT work_address, CAST(commuters AS DOUBLE) AS w, (duration - lo) / st AS pos, least(CAST(floor((duration - lo) / st) AS BIGINT), 1023) AS l FROM routes, r WHERE commuters > 0),"
    " b AS (SELECT work_address, l AS bin, w * (1 - (pos - l)) AS w FROM p UNION ALL SELECT work_address, l + 1, w * (pos - l) FROM p),"
    " c AS (SELECT work_address, lo + bin * st AS c, sum(w) AS w FROM b, r GROUP BY 1, 2),"
    " g AS (SELECT i, lo + i * (hi - lo) / 511 AS x FROM r, (SELECT unnest(range(512)) AS i) q)"
    " SELECT work_address, CAST(i AS INTEGER) AS i, round(any_value(x), 6) AS x, round(sum(w * exp(-((x - c) / 2) * ((x - c) / 2) / 2) / (2 * sqrt(2 * pi()))) / sum(w), 9) AS density"
    " FROM c, g GROUP BY work_address, i"
)


@query("density", _DENSITY)
def density(t: Tables) -> DataFrame:
    out = s.density(t.routes, "duration", weight="commuters", by=["work_address"], bw=_BAND)
    return out.withColumns({"x": F.round("x", 6), "density": F.round("density", 9)})


@query(
    "density_bandwidth",
    "SELECT home_address, round(0.9 * least(stddev_samp(duration), (quantile_cont(duration, 0.75) - quantile_cont(duration, 0.25)) / 1.34)"
    " * pow(count(duration), -0.2), 9) AS bw FROM routes GROUP BY 1",
)
def density_bandwidth(t: Tables) -> DataFrame:
    return s.bandwidth(t.routes, "duration", ["home_address"]).withColumn("bw", F.round("bw", 9))


@query(
    "step_curve",
    "SELECT row_number() OVER (ORDER BY commuters DESC, h_geocode, w_geocode) AS id, CAST(sum(commuters) OVER (ORDER BY commuters DESC,"
    " h_geocode, w_geocode ROWS UNBOUNDED PRECEDING) AS DOUBLE) / (SELECT sum(commuters) FROM flows_pair) AS cumulative_pct_commuters FROM flows_pair",
)
def step_curve(t: Tables) -> DataFrame:
    curve = cumulative_share(t.flows_pair, "commuters", ["h_geocode", "w_geocode"])
    return curve.select("id", "cumulative_pct_commuters")


@query(
    "step_curve_real",
    "WITH r AS (SELECT w_tract, duration / CAST(60 AS DOUBLE) AS hours FROM routes) SELECT row_number() OVER (ORDER BY hours DESC, w_tract) AS id,"
    " round(sum(hours) OVER (ORDER BY hours DESC, w_tract ROWS UNBOUNDED PRECEDING) / (SELECT sum(hours) FROM r), 9) AS cumulative_pct_hours FROM r",
)
def step_curve_real(t: Tables) -> DataFrame:
    hours = t.routes.select("w_tract", (F.col("duration") / F.lit(60.0)).alias("hours"))
    curve = cumulative_share(hours, "hours", ["w_tract"])
    return curve.select("id", F.round("cumulative_pct_hours", 9).alias("cumulative_pct_hours"))


_UNIT = "(commuters - (SELECT min(commuters) FROM flows_pair)) / CAST((SELECT max(commuters) - min(commuters) FROM flows_pair) AS DOUBLE)"


@query(
    "rescale_range",
    f"SELECT *, round({_UNIT} * 1.4 + 0.1, 9) AS edge_width, round(sqrt({_UNIT}) * 2.2 + 0.3, 9) AS size FROM flows_pair",
)
def rescale_range(t: Tables) -> DataFrame:
    wide = s.rescale_range(t.flows_pair, "commuters", 0.1, 1.5, out="edge_width")
    wide = s.rescale_range(wide, "commuters", 0.3, 2.5, method="area", out="size")
    return wide.withColumns({c: F.round(c, 9) for c in ("edge_width", "size")})


@query("facet_split", "SELECT work_address AS facet, home_address, avg(duration) AS mean_duration FROM routes GROUP BY ALL")
def facet_split(t: Tables) -> DataFrame:
    return mean_by(t.routes.withColumnRenamed("work_address", "facet"), ["facet", "home_address"], "duration")


_ORD = "(SELECT {c}, row_number() OVER (ORDER BY median(commuters), {c}) AS {c}_ord FROM s GROUP BY 1)"


@query(
    "tile_matrix",
    "WITH s AS (SELECT c_nationkey AS h_tract, s_nationkey AS w_tract, CAST(max(S000) AS BIGINT) AS duration, CAST(sum(S000) AS BIGINT) AS commuters"
    " FROM flows_block JOIN customer ON h_geocode = c_custkey JOIN supplier ON w_geocode = s_suppkey GROUP BY ALL)"
    f" SELECT h.h_tract, w.w_tract, duration, commuters, h_tract_ord, w_tract_ord FROM {_ORD.format(c='h_tract')} h CROSS JOIN {_ORD.format(c='w_tract')} w"
    " LEFT JOIN s ON s.h_tract = h.h_tract AND s.w_tract = w.w_tract",
)
def tile_matrix_(t: Tables) -> DataFrame:
    ends = map_areas(t.flows_block, t.crosswalk, "tabblk2010", "trct", {"h_geocode": "h_tract", "w_geocode": "w_tract"})
    flows = ends.groupBy("h_tract", "w_tract").agg(F.max("S000").alias("duration"), F.sum("S000").alias("commuters"))
    return tile_matrix(flows, "h_tract", "w_tract", "duration", "commuters")
