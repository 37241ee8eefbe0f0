"""Geometry as arrays of structs, evaluated by Spark expressions.

point ``struct<x,y>``; line ``array<point>``; polygon ``array<array<point>>`` (rings, even-odd filled, a ring may
or may not repeat its first vertex).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from odweave.functions.semantics import _col


def point(x: str | Column, y: str | Column) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def xy(geom: str | Column) -> tuple[Column, Column]:
    """Coordinates of a point as two plain columns."""
    g = _col(geom)
    return g.getField("x"), g.getField("y")


def ring(*points: Column) -> Column:
    return F.array(*points)


def polygon(*rings: Column) -> Column:
    return F.array(*rings)


def box(xmin: str | Column, ymin: str | Column, xmax: str | Column, ymax: str | Column) -> Column:
    """Axis-parallel rectangle as a polygon."""
    x0, y0, x1, y1 = _col(xmin), _col(ymin), _col(xmax), _col(ymax)
    return polygon(ring(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))


def line_segments(line: str | Column) -> Column:
    """Consecutive vertex pairs ``array<struct<a,b>>`` of a line."""
    g = _col(line)
    heads = F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0)))
    tails = F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))
    return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _closed(r: Column) -> Column:
    return F.concat(r, F.slice(r, 1, 1))


def polygon_edges(poly: str | Column) -> Column:
    """All edges ``array<struct<a,b>>`` of all rings, each ring closed."""
    return F.flatten(F.transform(_col(poly), lambda r: line_segments(_closed(r))))


def _moments(poly: Column) -> Column:
    """Shoelace sums ``(area2, mx, my)`` over all edges, relative to the first vertex for accuracy."""
    origin = F.get(F.get(poly, F.lit(0)), F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc: Column, e: Column) -> Column:
        ax, ay = e["a"]["x"] - origin["x"], e["a"]["y"] - origin["y"]
        bx, by = e["b"]["x"] - origin["x"], e["b"]["y"] - origin["y"]
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (ax + bx) * cross).alias("mx"),
            (acc["my"] + (ay + by) * cross).alias("my"),
        )

    return F.aggregate(polygon_edges(poly), zero, add)


def signed_area(poly: str | Column) -> Column:
    """Area of a polygon whose holes run against its outer rings; negative if these run clockwise."""
    return _moments(_col(poly))["a"] / 2


def area(poly: str | Column) -> Column:
    """Area of a polygon whose holes run against the outer ring."""
    return F.abs(_moments(_col(poly))["a"]) / 2


def centroid(poly: str | Column) -> Column:
    """Area-weighted centroid as a point; NULL for a polygon without area."""
    g = _col(poly)
    m = _moments(g)
    origin = F.get(F.get(g, F.lit(0)), F.lit(0))
    return F.when(
        m["a"] != 0,
        F.struct(
            (origin["x"] + m["mx"] / (3 * m["a"])).alias("x"),
            (origin["y"] + m["my"] / (3 * m["a"])).alias("y"),
        ),
    )


def bbox(poly: str | Column) -> Column:
    """Bounding box ``struct<xmin,ymin,xmax,ymax>``."""
    pts = F.flatten(_col(poly))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_touch(
    px: Column, py: Column, qx: Column, qy: Column, ax: Column, ay: Column, bx: Column, by: Column
) -> Column:
    """Do segments p-q and a-b share a point? Covers touching and collinear overlap."""
    boxes = (
        (F.least(px, qx) <= F.greatest(ax, bx))
        & (F.least(ax, bx) <= F.greatest(px, qx))
        & (F.least(py, qy) <= F.greatest(ay, by))
        & (F.least(ay, by) <= F.greatest(py, qy))
    )
    d1, d2 = _turn(px, py, qx, qy, ax, ay), _turn(px, py, qx, qy, bx, by)
    d3, d4 = _turn(ax, ay, bx, by, px, py), _turn(ax, ay, bx, by, qx, qy)
    return boxes & (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)


def way_crosses_edge(
    px: Column, py: Column, qx: Column, qy: Column, ax: Column, ay: Column, bx: Column, by: Column
) -> Column:
    """Does the way from p to q cross edge a-b? A vertex on the way belongs to one side, so it is crossed once."""
    ends_apart = (_turn(px, py, qx, qy, ax, ay) >= 0) != (_turn(px, py, qx, qy, bx, by) >= 0)
    return ends_apart & ((_turn(ax, ay, bx, by, px, py) >= 0) != (_turn(ax, ay, bx, by, qx, qy) >= 0))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), F.lit(2.0)
    )
    return F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
