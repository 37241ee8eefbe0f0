"""Exact polygon algebra on edges: outlines of dissolved groups, shared areas, areas of differences.

A polygon's holes run against its outer rings; which way these run does not matter. No geometry is cut into cells and no
group of polygons is gathered: edges are rows, and meet through equi joins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.functions.geometry import bbox, polygon_edges, signed_area
from odweave.operators.joins import join
from odweave.operators.spatial import _levels, _size
from odweave.session import materialize


def oriented_edges(df: DataFrame, keep: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """One row per edge that has a length: ``keep`` and ``ax, ay, bx, by``, with the polygon on its left."""
    rows = df.select(*keep, (signed_area(geometry) < 0).alias("__turned"), F.explode(polygon_edges(geometry)).alias("__e"))
    ends = [F.when(F.col("__turned"), F.col(f"__e.{q}.{c}")).otherwise(F.col(f"__e.{p}.{c}")).alias(f"{n}{c}") for n, p, q in (("a", "a", "b"), ("b", "b", "a")) for c in "xy"]
    return rows.select(*keep, *ends).filter("ax <> bx or ay <> by")


# --- outlines ------------------------------------------------------------------------------------------------

def outline_edges(df: DataFrame, keys: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """Edges of the union of each group's polygons, which may touch along whole edges but not overlap.

    An edge that two polygons share runs one way in one and the other way in the other: the two cancel. Copies of a polygon
    count once; an edge that is left twice is an error, as the polygons overlap.
    """
    edges = oriented_edges(df.select(*keys, geometry).distinct(), keys, geometry)
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    flat = edges.select(*keys, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(a < b, 1).otherwise(-1).alias("way"))
    left = flat.groupBy(*keys, "lo", "hi").agg(F.sum("way").alias("net")).filter("net <> 0")
    net = F.when(F.abs("net") > 1, F.raise_error(F.lit("polygons of a group overlap"))).otherwise(F.col("net"))
    first, last = F.when(net > 0, F.col("lo")).otherwise(F.col("hi")), F.when(net > 0, F.col("hi")).otherwise(F.col("lo"))
    return left.select(*keys, first["x"].alias("ax"), first["y"].alias("ay"), last["x"].alias("bx"), last["y"].alias("by"))


def dissolve_rings(df: DataFrame, keys: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """The outline of each group's union as rings: a row per vertex with ``keys``, ring, place (from 0), x, y and hole.

    Outer rings run counter-clockwise, holes clockwise. Where rings touch in a point they stay apart. Every edge finds the edge
    that follows it (of several, the one furthest to the left); pointer doubling then gives each edge the smallest edge id of
    its ring, and its distance to that edge. Rounds grow with the logarithm of the longest ring, each is a stored table, and a ring's
    vertices stay rows. Neighbours must have the same vertices along a shared border.
    """
    keys = list(keys)
    edges = materialize(outline_edges(df, keys, geometry).withColumn("edge", F.monotonically_increasing_id()))
    after = edges.select(*keys, F.col("edge").alias("next"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    back = F.atan2(F.expr("ay - by"), F.expr("ax - bx"))
    turn = F.pmod(back - F.atan2(F.expr("cy - by"), F.expr("cx - bx")), F.lit(2 * math.pi))
    turn = F.when(turn <= 0, F.lit(2 * math.pi)).otherwise(turn)  # straight back comes last
    pairs = join(edges, after, [*keys, "bx", "by"], "inner")
    follows = materialize(pairs.groupBy("edge").agg(F.min_by("next", turn).alias("to")))

    def doubled(state: DataFrame, value: Column) -> DataFrame:
        """``value`` of a row and of the row that its pointer leads to, and the pointer of that row."""
        there = state.select(F.col("edge").alias("to"), F.col("to").alias("then"), F.col("v").alias("v_then"))
        return materialize(state.join(there, "to").select("edge", F.col("then").alias("to"), value.alias("v"), F.col("v").alias("was")))

    rings, changed = follows.withColumn("v", F.least("edge", "to")), True
    while changed:
        rings = doubled(rings, F.least("v", "v_then"))
        changed = not rings.filter("v <> was").isEmpty()
    rings = rings.select("edge", F.col("v").alias("ring"))
    head = F.col("edge") == F.col("ring")
    steps = follows.join(rings, "edge")
    steps = steps.select("edge", F.when(head, F.col("edge")).otherwise(F.col("to")).alias("to"), F.when(head, 0).otherwise(1).cast("bigint").alias("v"))
    changed = True
    while changed:
        steps = doubled(steps, F.col("v") + F.col("v_then"))
        changed = not steps.filter("v <> was").isEmpty()
    placed = edges.join(rings, "edge").join(steps.select("edge", F.col("v").alias("ahead")), "edge")
    sums = placed.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("ax * by - bx * ay")).alias("twice"))
    place = F.when(F.col("ahead") == 0, F.lit(0)).otherwise(F.col("n") - F.col("ahead"))
    return placed.join(sums, "ring").select(*keys, "ring", place.alias("place"), F.col("ax").alias("x"), F.col("ay").alias("y"), (F.col("twice") < 0).alias("hole"))


# --- areas ---------------------------------------------------------------------------------------------------

#: Edges of a pair of polygons in one of its columns, about.
_PER_COLUMN = 8


def _boxes(df: DataFrame, ids: Sequence[str], geometry: str, tag: str) -> DataFrame:
    box = bbox(geometry)
    made = df.select(F.struct(*ids).alias(f"{tag}_id"), *[box[c].alias(f"{tag}_{c}") for c in ("xmin", "ymin", "xmax", "ymax")], F.size(F.flatten(geometry)).alias(f"{tag}_n"))
    wide = F.greatest(F.col(f"{tag}_xmax") - F.col(f"{tag}_xmin"), F.col(f"{tag}_ymax") - F.col(f"{tag}_ymin"))
    return made.withColumn("level", F.ceil(F.log2(F.greatest(wide, F.lit(1e-300)))).cast("int"))


def _box_cover(boxes: DataFrame, tag: str, others: Column, asks: int, meets: Sequence[int]) -> DataFrame:
    """A box's cells of about its own size (four at most), and those of larger sizes among the ``others``; see ``segment_cover``."""
    own = F.col("level")
    here = [F.struct(own.alias("at"), (own * 2 + kind).alias("slot")) for kind in meets]
    above = F.transform(F.filter(others, lambda at: at > own), lambda at: F.struct(at.alias("at"), (at * 2 + asks).alias("slot")))
    rows = boxes.select("*", F.inline(F.concat(F.array(*here), above)))
    for c in "xy":
        size = _size("at", 1.0)
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{tag}_{c}min") / size), F.floor(F.col(f"{tag}_{c}max") / size))))
    return rows.drop("level", "at")


def shared_areas(a: DataFrame, b: DataFrame, ids_a: Sequence[str], ids_b: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """``ids_a``, ``ids_b`` and shared_area of every pair of polygons that share an area. Ids must be unique.

    With a sign for the way an edge runs, the area that two polygons share is the sum, over pairs of their edges, of the signed
    area between the upper and the lower edge where the first polygon's is above. That is a closed form per pair of edges, so nothing is
    clipped or cut into cells. Pairs of polygons meet through boxes in a quadtree; a pair's edges meet in columns of its own, as
    many as its edges call for, so two large polygons are many small groups.
    """
    left, right = (materialize(_boxes(df, ids, geometry, t)) for df, ids, t in ((a, ids_a, "a"), (b, ids_b, "b")))
    levels = [_levels(r[0] for r in boxes.select("level").distinct().collect()) for boxes in (left, right)]
    near_a, near_b = _box_cover(left, "a", levels[1], 1, [0]), _box_cover(right, "b", levels[0], 0, [0, 1])
    overlap = F.expr("a_xmin < b_xmax and b_xmin < a_xmax and a_ymin < b_ymax and b_ymin < a_ymax")
    met = near_a.join(near_b.withColumnsRenamed({c: f"b_{c}" for c in ("slot", "cx", "cy")}), F.expr("slot = b_slot and cx = b_cx and cy = b_cy") & overlap)
    # several cells can hold a pair: it counts where its common corner lies
    size = F.pow(F.lit(2.0), F.floor(F.col("slot") / 2))
    corner = (F.floor(F.greatest("a_xmin", "b_xmin") / size) == F.col("cx")) & (F.floor(F.greatest("a_ymin", "b_ymin") / size) == F.col("cy"))
    pairs = met.filter(corner).select(
        "a_id", "b_id", F.greatest("a_xmin", "b_xmin").alias("from"), F.least("a_xmax", "b_xmax").alias("to"),
        F.ceil((F.col("a_n") + F.col("b_n")) / _PER_COLUMN).alias("columns"), F.col("a_ymax").alias("above"), F.col("b_ymin").alias("below"),
    )
    pairs = materialize(pairs.withColumn("width", (F.col("to") - F.col("from")) / F.col("columns")))

    def in_columns(df: DataFrame, ids: Sequence[str], tag: str, needed: Column) -> DataFrame:
        """The pieces of each pair's edges in its columns: x from l to r, y at both ends, and the sign of the way."""
        edges = oriented_edges(df.select(F.struct(*ids).alias(f"{tag}_id"), geometry), [f"{tag}_id"], geometry).filter("ax <> bx")
        rows = pairs.join(edges, f"{tag}_id").filter((F.greatest("ax", "bx") > F.col("from")) & (F.least("ax", "bx") < F.col("to")) & needed)
        lo, hi = F.greatest(F.least("ax", "bx"), "from"), F.least(F.greatest("ax", "bx"), "to")
        last = F.col("columns") - 1
        first = F.least(F.floor((lo - F.col("from")) / F.col("width")), last)
        rows = rows.withColumn("column", F.explode(F.sequence(first, F.least(F.floor((hi - F.col("from")) / F.col("width")), last))))
        start = F.col("from") + F.col("column") * F.col("width")
        end = F.when(F.col("column") == last, F.col("to")).otherwise(F.col("from") + (F.col("column") + 1) * F.col("width"))
        names = [F.col(c).alias(f"{tag}{c}") for c in ("ax", "ay", "bx", "by")]
        rows = rows.select("a_id", "b_id", "column", F.greatest(lo, start).alias(f"{tag}l"), F.least(hi, end).alias(f"{tag}r"), *names)
        return rows.filter(F.col(f"{tag}l") < F.col(f"{tag}r"))

    up = in_columns(a, ids_a, "a", F.greatest("ay", "by") > F.col("below"))
    low = in_columns(b, ids_b, "b", F.least("ay", "by") < F.col("above"))
    both = up.join(low, ["a_id", "b_id", "column"]).withColumns({"l": F.greatest("al", "bl"), "r": F.least("ar", "br")}).filter("l < r")

    def height(tag: str, at: str) -> Column:
        return F.expr(f"{tag}ay + ({at} - {tag}ax) * (({tag}by - {tag}ay) / ({tag}bx - {tag}ax))")

    both = both.withColumns({"dl": height("a", "l") - height("b", "l"), "dr": height("a", "r") - height("b", "r")})
    over, under = F.greatest("dl", "dr"), F.least("dl", "dr")
    part = F.when(under >= 0, (over + under) / 2).when(over <= 0, F.lit(0.0)).otherwise(over * over / (2 * (over - under)))
    sign = F.signum(F.expr("abx - aax")) * F.signum(F.expr("bbx - bax"))
    sums = both.groupBy("a_id", "b_id").agg(F.sum(-sign * part * F.expr("r - l")).alias("shared_area")).filter("shared_area > 0")
    return sums.select("a_id.*", "b_id.*", "shared_area")


def erased_areas(areas: DataFrame, mask: DataFrame, ids: Sequence[str], mask_ids: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """``ids``, area and left_area: what the mask's polygons leave of each area. They must not overlap one another.

    Areas that meet no mask polygon stay whole. The left area is the area minus what it shares with each mask polygon.
    """
    gone = shared_areas(areas, mask, ids, mask_ids, geometry).groupBy(*ids).agg(F.sum("shared_area").alias("__gone"))
    whole = areas.select(*ids, F.abs(signed_area(geometry)).alias("area"))
    out = join(whole, gone, list(ids), na_matches="na")
    return out.select(*ids, "area", F.greatest(F.col("area") - F.coalesce("__gone", F.lit(0.0)), F.lit(0.0)).alias("left_area"))
