"""Spatial operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import CELL, Tables
from odweave.catalog.registry import query
from odweave.functions.geometry import bbox, box, centroid, point, xy
from odweave.operators import spatial as s
from odweave.operators.joins import join
from odweave.operators.polygons import dissolve_rings, erased_areas, shared_areas
from odweave.operators.quality import missing_rows
from odweave.operators.reshape import flags_to_rows, unpivot
from odweave.operators.verbs import agg_top_k, top_k
from odweave.operators.windows import add_row_id


@query("geo_centroid", "SELECT vec_id, round(x + s * 5 / 6, 6) AS x, round(y + s * 5 / 6, 6) AS y FROM plots")
def geo_centroid(t: Tables) -> DataFrame:
    x, y = xy(centroid("geometry"))
    return t.plots.select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("geo_xy", "SELECT vec_id, x, y FROM points")
def geo_xy(t: Tables) -> DataFrame:
    x, y = xy("geometry")
    return t.points.select("vec_id", point("x", "y").alias("geometry")).select("vec_id", x.alias("x"), y.alias("y"))


@query("geo_points", "SELECT l_orderkey, l_partkey, l_extendedprice AS px, l_quantity AS py FROM lineitem")
def geo_points(t: Tables) -> DataFrame:
    made = t.lineitem.select("l_orderkey", "l_partkey", point("l_extendedprice", "l_quantity").alias("geometry"))
    return made.select("l_orderkey", "l_partkey", F.col("geometry.x").alias("px"), F.col("geometry.y").alias("py"))


@query(
    "geo_make_line",
    "WITH f AS (SELECT *, row_number() OVER (ORDER BY commuters DESC, h_geocode, w_geocode) AS line_id FROM flows_pair)"
    " SELECT line_id, commuters, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM f JOIN points a ON h_geocode = a.vec_id JOIN points b ON w_geocode = b.vec_id",
)
def geo_make_line(t: Tables) -> DataFrame:
    flows = add_row_id(t.flows_pair, ["-commuters", "h_geocode", "w_geocode"], "line_id")
    ends = unpivot(flows, ["line_id", "commuters"], ["h_geocode", "w_geocode"], "tract_type", "GEOID")
    at = t.points.select(F.col("vec_id").alias("GEOID"), point("x", "y").alias("geometry"))
    placed = join(ends, at, "GEOID", "inner", "never")
    lines = s.make_lines(placed, ["line_id", "commuters"], ["tract_type"]).filter(F.size("geometry") == 2)
    first, last = F.get("geometry", F.lit(0)), F.get("geometry", F.lit(1))
    return lines.select(
        "line_id", "commuters", first["x"].alias("x1"), first["y"].alias("y1"), last["x"].alias("x2"), last["y"].alias("y2")
    )


@query("geo_dissolve", "SELECT DISTINCT label, cx, cy FROM plot_cells")
def geo_dissolve(t: Tables) -> DataFrame:
    return s.dissolve(t.plots, ["label"], CELL)


@query("geo_dissolve_lines", "SELECT l_orderkey, count(*) AS parts FROM (SELECT DISTINCT * FROM step_lines) q GROUP BY 1")
def geo_dissolve_lines(t: Tables) -> DataFrame:
    parts = s.dissolve_lines(t.step_lines, ["l_orderkey"])
    return parts.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("parts"))


@query(
    "geo_erase",
    "SELECT vec_id, count(*) AS cells, round(count(*) * (CAST(0.02 AS DOUBLE) * CAST(0.02 AS DOUBLE)), 9) AS area FROM plot_cells p"
    " WHERE NOT EXISTS (SELECT 1 FROM water_cells w WHERE w.cx = p.cx AND w.cy = p.cy) GROUP BY 1",
)
def geo_erase(t: Tables) -> DataFrame:
    land = s.cell_area(s.erase(t.plots, t.water, ["vec_id"], CELL), ["vec_id"], CELL)
    return land.withColumn("area", F.round("area", 9))


@query(
    "geo_overlay",
    "SELECT vec_id, zone, count(*) AS cells FROM plot_cells p JOIN zone_cells z USING (cx, cy) GROUP BY ALL",
)
def geo_overlay(t: Tables) -> DataFrame:
    return s.overlay(t.plots, t.zones, ["vec_id"], ["zone"], CELL).drop("shared_area")


# Outlines of cell sets: boundary sides and corners of the lattice say how many edges and rings there must be.
_RINGS = (
    "c AS (SELECT DISTINCT label, cx, cy FROM plot_cells),"
    " s AS (SELECT c.label, count(*) AS edges FROM c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)"
    " WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.label = c.label AND o.cx = c.cx + dx AND o.cy = c.cy + dy) GROUP BY 1),"
    " q AS (SELECT label, cx + dx AS vx, cy + dy AS vy, sum(1 << (dx + 2 * dy)) AS quad FROM c, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy) GROUP BY 1, 2, 3),"
    " e AS (SELECT label, sum(CASE WHEN bit_count(quad::int) = 1 THEN 1 WHEN bit_count(quad::int) = 3 THEN -1 WHEN quad IN (6, 9) THEN 2 ELSE 0 END) // 4 AS rings FROM q GROUP BY 1)"
)


@query(
    "geo_dissolve_rings",
    f"WITH {_RINGS} SELECT label, edges, CAST(rings AS BIGINT) AS outer_less_holes, CAST(count(*) AS DOUBLE) AS area FROM c JOIN s USING (label) JOIN e USING (label) GROUP BY ALL",
)
def geo_dissolve_rings(t: Tables) -> DataFrame:
    cells = s.dissolve(t.plots, ["label"], CELL)
    squares = cells.select("label", box("cx", "cy", F.col("cx") + 1, F.col("cy") + 1).alias("geometry"))
    rings = dissolve_rings(squares, ["label"])
    first = F.struct(F.col("place").alias("p"), "x", "y")
    ahead = rings.select("ring", F.col("x").alias("nx"), F.col("y").alias("ny"), (F.col("place") - 1).alias("place"))
    last = rings.groupBy("ring").agg(F.max("place").alias("place"), F.min(first).alias("f")).select("ring", "f.x", "f.y", "place")
    closed = ahead.filter("place >= 0").unionByName(last.withColumnsRenamed({"x": "nx", "y": "ny"}))
    sides = join(rings, closed, ["ring", "place"], "inner")
    return sides.groupBy("label").agg(
        F.count(F.lit(1)).alias("edges"), F.sum(F.when(F.col("place") == 0, F.when(F.col("hole"), -1).otherwise(1)).otherwise(0)).alias("outer_less_holes"),
        (F.sum(F.expr("x * ny - nx * y")) / 2).alias("area"),
    )


# what a box shares with an L: its lower bar and the square on top of its left half
_PART = "greatest(least({a1}, {b1}) - greatest({a0}, {b0}), 0)"
_IN_BOX = (
    f"{_PART.format(a0='x', a1='x + 2 * s', b0='x0', b1='x1')} * {_PART.format(a0='y', a1='y + s', b0='y0', b1='y1')}"
    f" + {_PART.format(a0='x', a1='x + s', b0='x0', b1='x1')} * {_PART.format(a0='y + s', a1='y + 2 * s', b0='y0', b1='y1')}"
)


@query("geo_overlay_exact", f"SELECT * FROM (SELECT vec_id, zone, round({_IN_BOX}, 9) AS shared_area FROM plots, zones) q WHERE shared_area > 0")
def geo_overlay_exact(t: Tables) -> DataFrame:
    shared = shared_areas(t.plots, t.zones, ["vec_id"], ["zone"])
    return shared.withColumn("shared_area", F.round("shared_area", 9)).filter("shared_area > 0")


_STRIPES = "SELECT zone, zone * CAST(0.1 AS DOUBLE) - 1 AS x0, zone * CAST(0.1 AS DOUBLE) - CAST(0.95 AS DOUBLE) AS x1, y0, y1 FROM zones"


@query(
    "geo_erase_exact",
    f"SELECT vec_id, round(3 * s * s, 9) AS area, round(3 * s * s - sum({_IN_BOX}), 9) AS left_area FROM plots, ({_STRIPES}) z GROUP BY vec_id, s",
)
def geo_erase_exact(t: Tables) -> DataFrame:
    """Plots without stripes, one for each zone, that do not overlap one another."""
    b = bbox("geometry")
    west = F.col("zone") * 0.1 - 1
    stripes = t.zones.select("zone", box(west, b["ymin"], F.col("zone") * 0.1 - 0.95, b["ymax"]).alias("geometry"))
    left = erased_areas(t.plots, stripes, ["vec_id"], ["zone"])
    return left.withColumns({c: F.round(c, 9) for c in ("area", "left_area")})


# a segment meets a closed box if the part of it inside the box's x range overlaps the y range
_CROSS = (
    "rivers AS (SELECT FULLNAME, row_number() OVER (ORDER BY sum(AWATER) DESC, FULLNAME) AS rank FROM water GROUP BY 1 ORDER BY 2 LIMIT 4),"
    " sides AS (SELECT rank, x0 AS ex, y0 AS ey, x1 AS fx, y0 AS fy, x0, y0, x1, y1 FROM water JOIN rivers USING (FULLNAME) UNION ALL"
    " SELECT rank, x1, y0, x1, y1, x0, y0, x1, y1 FROM water JOIN rivers USING (FULLNAME) UNION ALL"
    " SELECT rank, x1, y1, x0, y1, x0, y0, x1, y1 FROM water JOIN rivers USING (FULLNAME) UNION ALL"
    " SELECT rank, x0, y1, x0, y0, x0, y0, x1, y1 FROM water JOIN rivers USING (FULLNAME)),"
    " turns AS (SELECT l_orderkey, rank, ax, ay, x0, y0, x1, y1, (bx - ax) * (ey - ay) - (by_ - ay) * (ex - ax) AS d1,"
    " (bx - ax) * (fy - ay) - (by_ - ay) * (fx - ax) AS d2, (fx - ex) * (ay - ey) - (fy - ey) * (ax - ex) AS d3,"
    " (fx - ex) * (by_ - ey) - (fy - ey) * (bx - ex) AS d4 FROM step_lines JOIN sides ON"
    " least(ax, bx) <= x1 AND x0 <= greatest(ax, bx) AND least(ay, by_) <= y1 AND y0 <= greatest(ay, by_)"
    " AND ((least(ax, bx) <= greatest(ex, fx) AND least(ex, fx) <= greatest(ax, bx) AND least(ay, by_) <= greatest(ey, fy)"
    " AND least(ey, fy) <= greatest(ay, by_)) OR (ax > x0 AND ax < x1 AND ay > y0 AND ay < y1))),"
    " met AS (SELECT DISTINCT l_orderkey, rank FROM turns WHERE (sign(d1) * sign(d2) <= 0 AND sign(d3) * sign(d4) <= 0)"
    " OR (ax > x0 AND ax < x1 AND ay > y0 AND ay < y1))"
)
_FLAGS = ["intersects_1", "intersects_2", "intersects_3", "intersects_4"]


def _flags(t: Tables) -> DataFrame:
    top = agg_top_k(t.water, "FULLNAME", "AWATER", 4).collect()
    names = {flag: row["FULLNAME"] for flag, row in zip(_FLAGS, top)}
    return s.crossing_flags(t.step_lines, t.water, ["l_orderkey"], "FULLNAME", names, CELL)


@query(
    "geo_intersects",
    f"WITH {_CROSS} SELECT o.l_orderkey, "
    + ", ".join(f"coalesce(bool_or(rank = {i}), false) AS intersects_{i}" for i in range(1, 5))
    + " FROM (SELECT DISTINCT l_orderkey FROM step_lines) o LEFT JOIN met m ON m.l_orderkey = o.l_orderkey GROUP BY 1",
)
def geo_intersects(t: Tables) -> DataFrame:
    return _flags(t)


@query(
    "geo_crossing_summary",
    f"WITH {_CROSS} SELECT CAST(rank AS VARCHAR) AS river, count(*) AS routes FROM met GROUP BY 1",
)
def geo_crossing_summary(t: Tables) -> DataFrame:
    rows = flags_to_rows(_flags(t), _FLAGS, ["l_orderkey"], prefix="intersects_", names_to="river")
    return rows.groupBy("river").agg(F.count(F.lit(1)).alias("routes"))


@query("geo_srid", "SELECT vec_id, 4269 AS srid, 6 AS vertices FROM plots")
def geo_srid(t: Tables) -> DataFrame:
    tagged = s.assert_srid(s.set_srid(t.plots, 4269), 4269)
    return tagged.select("vec_id", "srid", F.size(F.get("geometry", F.lit(0))).alias("vertices"))


@query(
    "geo_reproject",
    "SELECT vec_id, 3857 AS srid, round(radians(x) * 6378137, 4) AS east, round(ln(tan(radians(y) / 2 + pi() / 4)) * 6378137, 4) AS north,"
    " round(x, 7) AS lon, round(y, 7) AS lat FROM points",
)
def geo_reproject(t: Tables) -> DataFrame:
    """Points on a web map, and back in degrees by way of an equal-area map."""
    points = s.set_srid(t.points.select("vec_id", point("x", "y").alias("geometry")), 4326)
    web = s.reproject(points, 4326, 3857)
    back = s.reproject(s.reproject(s.reproject(web.withColumn("web", F.col("geometry")), 3857, 5070), 5070, 4269), 4269, 4326)
    places = [F.round(F.col(f"web.{c}"), 4).alias(n) for c, n in (("x", "east"), ("y", "north"))]
    degrees = [F.round(F.col(f"geometry.{c}"), 7).alias(n) for c, n in (("x", "lon"), ("y", "lat"))]
    return back.select("vec_id", F.lit(3857).alias("srid"), *places, *degrees)


@query("geo_drop", "SELECT vec_id, label FROM plots")
def geo_drop(t: Tables) -> DataFrame:
    return s.drop_geometry(t.plots)


@query(
    "geo_attach",
    "SELECT coalesce(w_geocode, vec_id) AS area, n, x IS NULL AS no_geometry FROM (SELECT w_geocode, CAST(sum(commuters) AS BIGINT) AS n FROM flows_pair GROUP BY 1) f"
    " FULL JOIN plots ON w_geocode = vec_id",
)
def geo_attach(t: Tables) -> DataFrame:
    flows = t.flows_pair.groupBy(F.col("w_geocode").alias("area")).agg(F.sum("commuters").alias("n"))
    out = s.attach_geometry(flows, t.plots.select("vec_id", "geometry"), {"area": "vec_id"})
    return out.select("area", "n", F.col("geometry").isNull().alias("no_geometry"))


@query("geo_missing", "SELECT c_custkey AS area FROM customer WHERE c_custkey NOT IN (SELECT vec_id FROM embeddings)")
def geo_missing(t: Tables) -> DataFrame:
    areas = t.customer.select(F.col("c_custkey").alias("area"))
    out = join(areas, t.plots.select("vec_id", "geometry"), {"area": "vec_id"}, na_matches="never")
    return missing_rows(out).select("area")


@query(
    "geo_zoom",
    "WITH c AS (SELECT x, y FROM points ORDER BY x DESC, vec_id LIMIT 1) SELECT p.vec_id, p.label, p.x, p.y FROM points p, c"
    " WHERE p.x BETWEEN c.x - 0.25 AND c.x + 0.25 AND p.y BETWEEN c.y - 0.25 AND c.y + 0.25",
)
def geo_zoom(t: Tables) -> DataFrame:
    return s.zoom(t.points, top_k(t.points, ["-x", "vec_id"], 1), 0.25)
