"""Spatial operators on grid cells and segments.

Overlay algebra works on cell sets: a polygon is the set of cells whose centre lies inside it (even-odd rule, so
holes and several parts just work). Union is distinct, difference an anti join, intersection an inner join on the
cell. Intersection of lines with polygons uses cells only to find candidates and tests them exactly.
Nothing here pairs all geometries: candidates always meet through an equi join on a cell or a grid column.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odweave.functions.geometry import bbox, polygon_edges, segments_touch, way_crosses_edge
from odweave.functions.projection import project_point
from odweave.operators.joins import By, join
from odweave.session import materialize, whole_if_small


def drop_geometry(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*(cols or ("geometry",)))


def attach_geometry(df: DataFrame, areas: DataFrame, by: By) -> DataFrame:
    """Bring geometry back onto an aggregate; areas without data are kept."""
    return join(df, areas, by=by, how="full", na_matches="never")


def set_srid(df: DataFrame, srid: int) -> DataFrame:
    """Tag a table with its coordinate reference system; no coordinates change."""
    return df.withColumn("srid", F.lit(srid))


def assert_srid(df: DataFrame, srid: int, geometry: str = "geometry") -> DataFrame:
    """Fail on the first row that carries another coordinate reference system."""
    wrong = F.raise_error(F.concat(F.lit(f"expected srid {srid}, found "), F.col("srid").cast("string")))
    return df.withColumn(geometry, F.when(F.col("srid").eqNullSafe(F.lit(srid)), F.col(geometry)).otherwise(wrong))


def reproject(df: DataFrame, source: int, target: int, geometry: str = "geometry") -> DataFrame:
    """Points, lines or polygons in another reference system; the table is tagged with it.

    A table that carries a tag must carry ``source``. Vertices are moved, edges stay straight between them.
    """
    def moved(geom: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.transform(geom, lambda part: moved(part, kind.elementType))
        return project_point(geom, source, target)

    known = assert_srid(df, source, geometry) if "srid" in df.columns else df
    return set_srid(known.withColumn(geometry, moved(F.col(geometry), df.schema[geometry].dataType)), target)


# --- polygons as cell sets -----------------------------------------------------------------------------------

def _first_cell(v: Column, cell: float, at: float) -> Column:
    """Index of the first cell whose reference point, ``at`` of the way through it, is not below ``v``."""
    return F.ceil(v / F.lit(cell) - at)


def _shape_id(geometry: str) -> Column:
    return F.struct(F.xxhash64(geometry).alias("h"), F.hash(geometry).alias("g"))


def polygon_cells(df: DataFrame, ids: Sequence[str], cell: float, geometry: str = "geometry") -> DataFrame:
    """Cells (``cx``, ``cy``) whose centre lies inside each polygon, next to its ids. Copies of a polygon count once."""
    return _filled(df, ids, cell, geometry, (0.5, 0.5)).drop("__shape")


def _filled(df: DataFrame, ids: Sequence[str], cell: float, geometry: str, at: tuple[float, float]) -> DataFrame:
    """Cells whose reference point lies inside each polygon.

    Scan-line fill: every edge gives its crossing with the reference line of each grid column it spans, crossings are
    paired up per polygon and column, and each pair is filled. A polygon's edges and columns are separate rows, so
    one large polygon spreads over tasks.
    """
    e = df.select(*ids, _shape_id(geometry).alias("__shape"), F.posexplode(polygon_edges(geometry)).alias("__no", "__e"))
    a, b = F.col("__e.a"), F.col("__e.b")
    flip = a["x"] > b["x"]
    e = e.select(*ids, "__shape", "__no", F.when(flip, b).otherwise(a).alias("l"), F.when(flip, a).otherwise(b).alias("r"))
    lo, hi = _first_cell(F.col("l.x"), cell, at[0]), _first_cell(F.col("r.x"), cell, at[0]) - 1
    cols = e.filter(lo <= hi).withColumn("cx", F.explode(F.sequence(lo, hi)))
    x = (F.col("cx") + at[0]) * F.lit(cell)
    y = F.col("l.y") + (x - F.col("l.x")) * (F.col("r.y") - F.col("l.y")) / (F.col("r.x") - F.col("l.x"))
    hits = cols.select(*ids, "__shape", "cx", F.struct(y.alias("y"), F.col("__no").alias("no")).alias("__hit"))
    rows = hits.groupBy(*ids, "__shape", "cx").agg(F.array_sort(F.collect_set("__hit")).alias("__hits"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("__hits") / 2).cast("int") - 1),
        lambda i: F.struct(
            F.get("__hits", 2 * i)["y"].alias("y0"), F.get("__hits", 2 * i + 1)["y"].alias("y1")
        ),
    )
    spans = rows.filter(F.size("__hits") >= 2).select(*ids, "__shape", "cx", F.inline(pairs))
    lo, hi = _first_cell(F.col("y0"), cell, at[1]), _first_cell(F.col("y1"), cell, at[1]) - 1
    return spans.filter(lo <= hi).select(*ids, "__shape", "cx", F.explode(F.sequence(lo, hi)).alias("cy"))


def dissolve(df: DataFrame, keys: Sequence[str], cell: float, geometry: str = "geometry") -> DataFrame:
    """Union of the polygons of each group, as distinct cells."""
    return polygon_cells(df, keys, cell, geometry).distinct()


def dissolve_lines(df: DataFrame, keys: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """Union of the lines of each group: its distinct parts, one row each, so that no group is gathered."""
    return df.select(*keys, geometry).distinct()


def cell_area(cells: DataFrame, keys: Sequence[str], cell: float, out: str = "area") -> DataFrame:
    counted = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"))
    return counted.withColumn(out, F.col("cells") * F.lit(cell * cell))


def erase(
    areas: DataFrame, mask: DataFrame, ids: Sequence[str], cell: float, geometry: str = "geometry"
) -> DataFrame:
    """Cells of the areas that no mask polygon covers (land without water)."""
    water = polygon_cells(mask, [], cell, geometry).distinct()
    return join(polygon_cells(areas, ids, cell, geometry), water, by=["cx", "cy"], how="anti", na_matches="never")


def overlay(
    a: DataFrame, b: DataFrame, ids_a: Sequence[str], ids_b: Sequence[str], cell: float, geometry: str = "geometry"
) -> DataFrame:
    """Pairs of polygons that share cells, with the number of shared cells and their area."""
    left, right = polygon_cells(a, ids_a, cell, geometry), polygon_cells(b, ids_b, cell, geometry)
    shared = join(left, right, by=["cx", "cy"], how="inner", na_matches="never")
    return cell_area(shared, [*ids_a, *ids_b], cell, "shared_area")


# --- lines against polygons -----------------------------------------------------------------------------------

# off-centre, so that edges drawn on round coordinates do not run through a reference point
_REFERENCE = (0.5132719, 0.4871543)
#: Cells of its own level that a segment spans at most.
_ACROSS = 16
#: Cells in which starts are told, on a side of the smallest cell in which segments meet: the smaller, the fewer edges they hold.
_FINE = 4
#: Cells of its own fill that a simple polygon spans at most; it takes no blocks of them.
_FILLED = 32
#: Levels are this many doublings apart: fewer levels mean fewer rows above a segment's own.
_STEP = 2
#: Cells of a grid column that make a block of the next size.
_BLOCK = 8


def _flat(segment: str, a: str, b: str) -> list[Column]:
    """Ends of a segment struct as four columns."""
    return [F.col(f"{segment}.{e}.{c}").alias(n + c) for e, n in (("a", a), ("b", b)) for c in "xy"]


def _level(extent: Column, cell: float, across: Column | int = _ACROSS) -> Column:
    """The lowest level of a quadtree, with cells of ``cell * 2^level``, at which an extent spans ``across`` cells or less."""
    doublings = F.log2(F.greatest(extent / (F.lit(cell) * across), F.lit(1.0)))
    return (F.ceil(doublings / _STEP) * _STEP).cast("int")


def _size(level: str, cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(2.0), F.col(level))


def _levels(found: Iterable[int]) -> Column:
    """The levels that occur, as a constant array. There are no more of them than exponents of a double."""
    return F.array(*[F.lit(int(level)) for level in found]).cast("array<int>")


def _covered(df: DataFrame, ends: Sequence[str], level: str, cell: float, explode: Callable[[Column], Column] = F.explode) -> DataFrame:
    """Cells ``cx, cy`` of the row's level that a segment passes through (a hair more, never less), one row each.

    ``explode_outer`` keeps a row without a segment, in no cell. Every intermediate is a column of its own: inlined into one another, the expressions make a generated method too
    large for the JVM to compile.
    """
    a_x, a_y, b_x, b_y = (F.col(c) for c in ends)
    s = df.withColumns({"__c": _size(level, cell), "__x0": F.least(a_x, b_x), "__x1": F.greatest(a_x, b_x)})
    size, pad = F.col("__c"), F.col("__c") * 1e-6
    # a nearly vertical segment has no slope and covers its whole height in each of its columns
    s = s.withColumn("__m", F.when(F.abs(b_x - a_x) > size * 1e-3, F.try_divide(b_y - a_y, b_x - a_x)))
    s = s.withColumn("cx", explode(F.sequence(F.floor((F.col("__x0") - pad) / size), F.floor((F.col("__x1") + pad) / size))))
    s = s.withColumns(
        {
            "__yl": a_y + (F.greatest("__x0", F.col("cx") * size) - a_x) * F.col("__m"),
            "__yr": a_y + (F.least("__x1", (F.col("cx") + 1) * size) - a_x) * F.col("__m"),
        }
    )
    s = s.withColumns(
        {
            "__lo": F.greatest(F.least(a_y, b_y), F.least("__yl", "__yr")),
            "__hi": F.least(F.greatest(a_y, b_y), F.greatest("__yl", "__yr")),
        }
    )
    rows = F.sequence(F.floor((F.col("__lo") - pad) / size), F.floor((F.col("__hi") + pad) / size))
    return s.select(*df.columns, "cx", explode(rows).alias("cy"))


def segment_cover(
    df: DataFrame, ends: Sequence[str], others: Column | None, cell: float, asks: int, meets: Sequence[int],
    explode: Callable[[Column], Column] = F.explode, also: Sequence[Column] = (),
) -> DataFrame:
    """A segment's cells ``cx, cy`` at its own level (column ``level``) and, above it, at the levels of the ``others``.

    ``slot`` is twice the cell's level plus a kind. Kinds make two covers meet once, at the higher of both levels: cells of a
    segment's own level carry the kinds ``meets``, those above it the kind ``asks``; the other side has them the other way round.
    If the ``others`` have the lowest level only, none is above.
    """
    own = F.col("level")
    here = [F.struct(own.alias("at"), (own * 2 + kind).alias("slot")) for kind in meets]
    if others is None:
        at = F.array(*here, *also)
        return _covered(df.select("*", F.inline(at)), ends, "at", cell, explode).drop("level", "at")
    above = F.transform(F.filter(others, lambda at: at > own), lambda at: F.struct(at.alias("at"), (at * 2 + asks).alias("slot")))
    return _covered(df.select("*", F.inline(F.concat(F.array(*here, *also), above))), ends, "at", cell, explode).drop("level", "at")


def _inside_blocks(shapes: DataFrame, cell: float, largest: int) -> list[DataFrame]:
    """Cells of each shape's level whose reference point lies inside it, as blocks of 1, 8, 64, ... cells of a grid column.

    The fill is the scan line's of ``_filled`` on cells of the shape's own size; a run of cells in a column becomes few blocks.
    One table for each size of block: ``cy`` counts blocks.
    """
    e = shapes.select("__shape", "__name", "level", F.posexplode(polygon_edges("__poly")).alias("__no", "__e"))
    e = e.select("__shape", "__name", "level", "__no", *_flat("__e", "e", "f")).withColumn("__c", _size("level", cell))
    flip, size = F.col("ex") > F.col("fx"), F.col("__c")
    for n, (one, other) in {"l": ("e", "f"), "r": ("f", "e")}.items():
        e = e.withColumns({f"{n}{c}": F.when(flip, F.col(f"{other}{c}")).otherwise(F.col(f"{one}{c}")) for c in "xy"})
    at_x, at_y = _REFERENCE
    lo, hi = F.ceil(F.col("lx") / size - at_x), F.ceil(F.col("rx") / size - at_x) - 1
    cols = e.filter(lo <= hi).withColumn("cx", F.explode(F.sequence(lo, hi)))
    y = F.col("ly") + ((F.col("cx") + at_x) * size - F.col("lx")) * (F.col("ry") - F.col("ly")) / (F.col("rx") - F.col("lx"))
    owner = ["__shape", "__name", "level"]
    hits = cols.groupBy(*owner, "__c", "cx").agg(F.array_sort(F.collect_list(y)).alias("__ys")).filter(F.size("__ys") >= 2)
    spans = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("__ys") / 2).cast("int") - 1),
        lambda i: F.struct(
            F.ceil(F.get("__ys", 2 * i) / size - at_y).alias("from"), F.ceil(F.get("__ys", 2 * i + 1) / size - at_y).alias("to")
        ),
    )
    runs = hits.select(*owner, "cx", F.inline(spans)).filter(F.col("from") < F.col("to"))
    parts = []
    for k in range(largest + 1):
        unit = _BLOCK**k
        first, end = F.ceil(F.col("from") / unit), F.floor(F.col("to") / unit)
        # blocks whose whole next larger block lies in the run belong to that one
        wide_from, wide_to = F.ceil(F.col("from") / (unit * _BLOCK)) * _BLOCK, F.floor(F.col("to") / (unit * _BLOCK)) * _BLOCK
        alone = F.sequence(first, end - 1)
        if k < largest:
            alone = F.filter(alone, lambda i: (wide_from >= wide_to) | (i < wide_from) | (i >= wide_to))
        parts.append(runs.filter(first < end).select(*owner, "cx", F.explode(alone).alias("cy")))
    return parts


def _fill_levels(shapes: DataFrame, geometry: str, cell: float) -> DataFrame:
    """Shapes with the level of their own fill and their extent in its cells: the more edges, the finer, so that a cell holds few."""
    box = bbox(geometry)
    extent = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    across = _FILLED * F.ceil(F.sqrt(F.size(F.flatten(geometry)) / 4))
    leveled = shapes.withColumn("level", F.coalesce(_level(extent, cell, across), F.lit(0)))
    return leveled.withColumn("__wide", extent / _size("level", cell))


#: Edges of one shape in one cell that are told from a start together; more are cut into parts.
_FEW = 32


def _full_and_split(shapes: DataFrame, near: DataFrame, cell: float) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """Where a cell decides alone, and where edges do.

    First, by size of block, the blocks of cells inside a shape that none of its edges enters, once per name: a start in
    one of them is inside. Second, the cells that edges enter (``near``) whose reference point lies inside.
    """
    widest = shapes.agg(F.max("__wide")).first()[0] or 1.0
    largest = int(math.log(max(widest * 2 * _BLOCK / _FILLED / 1.01, 1.0), 2 * _BLOCK))
    place = ["__shape", "__name", "level", "cx", "cy"]
    parts, full = _inside_blocks(shapes, cell, largest), []
    for k in range(largest, -1, -1):
        entered = near.select(*place[:-1], F.floor(F.col("cy") / _BLOCK**k).alias("cy")).distinct()
        blocks = parts[k].select(*place)
        if k < largest:
            # a block of the next size that edges enter falls into those of this one
            blocks = blocks.unionAll(split.select(*place[:-1], F.explode(F.sequence(F.col("cy") * _BLOCK, F.col("cy") * _BLOCK + _BLOCK - 1)).alias("cy")))
        both = blocks.withColumn("__in", F.lit(True)).unionAll(entered.withColumn("__in", F.lit(False)))
        both = materialize(both.groupBy(*place).agg(F.bool_or("__in").alias("__in"), F.bool_or(~F.col("__in")).alias("__by")).filter("__in"))
        full.append((k, materialize(both.filter("NOT __by").select("__name", "level", "cx", "cy").distinct())))
        split = both.filter("__by").select(*place)
    return full, split


def _edges_by_cell(near: DataFrame, inside: DataFrame, cell: float) -> DataFrame:
    """One row per shape and cell that its edges enter: the edges, the cell's reference point and whether that lies ``inside``.

    More than ``_FEW`` edges are cut into parts by hash, and the rows are marked as ``__many``.
    """
    place = ["__shape", "__name", "level", "cx", "cy"]
    many = F.col("__n") > _FEW
    counted = near.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"))
    part = F.pmod(F.xxhash64("ex", "ey", "fx", "fy"), F.ceil(F.col("__n") / _FEW))
    dealt = join(near, counted, place, "inner").withColumn("__part", part)
    rows = dealt.groupBy(*place, "__part").agg(
        F.collect_list(F.struct("ex", "ey", "fx", "fy")).alias("__edges"), F.any_value(many).alias("__many"), F.any_value("__box").alias("__box")
    )
    rows = join(rows, inside.withColumn("__odd", F.lit(True)), place).fillna(False, subset=["__odd"])
    reference = {f"r{c}": (F.col(f"c{c}") + _REFERENCE[i]) * _size("level", cell) for i, c in enumerate("xy")}
    return rows.withColumns(reference)


def _segments(lines: DataFrame, keys: Sequence[str], line: str, cell: float, unless: Column | None = None) -> DataFrame:
    """A row per segment, ``ax, ay, bx, by`` and its ``level``; a line of one vertex is a segment without length.

    Rows for which ``unless`` holds and lines without vertices stay as one row without a segment, if it is given.
    """
    at = F.sequence(F.lit(1), F.greatest(F.size(line) - 1, F.lit(1)))
    if unless is None:
        numbered = lines.filter(F.size(line) > 0).select(*keys, line, F.explode(at).alias("__at"))
    else:
        numbered = lines.select(*keys, line, F.explode_outer(F.when(~unless, at)).alias("__at"))
    a = F.get(line, F.col("__at") - 1)
    b = F.when(F.size(line) == 1, a).otherwise(F.get(line, F.col("__at")))
    ends = numbered.select(*keys, F.struct(a.alias("a"), b.alias("b")).alias("__s")).select(*keys, *_flat("__s", "a", "b"))
    return ends.withColumn("level", _level(F.greatest(F.abs(F.expr("bx - ax")), F.abs(F.expr("by - ay"))), cell))


_ENDS = ["ax", "ay", "bx", "by"]
_EDGE = ["ex", "ey", "fx", "fy"]


@dataclass(frozen=True)
class _Shapes:
    """The polygons' side, stored, and the lines: dealt out if few tasks held most of them."""

    lines: DataFrame
    edges: DataFrame  # by the cell and slot in which they meet segments
    edge_levels: Column | None
    fills: list[int]
    full: list[tuple[int, DataFrame]]  # blocks of cells in which every start is inside, by size
    by_cell: DataFrame  # edges that tell a start

    @property
    def fill_levels(self) -> Column:
        return _levels(self.fills)


def _above(levels: Iterable[int]) -> Column | None:
    return _levels(levels) if any(k > 0 for k in levels) else None


def _hidden(near: DataFrame, full: list[tuple[int, DataFrame]]) -> DataFrame:
    """Edges (``__name`` and ends) that lie in blocks of cells inside polygons of their own name alone.

    A line that starts outside and comes to such an edge has come through the border of what the name covers before.
    """
    edge, told, parts = ["__name", *_EDGE], near.select("__name", *_EDGE, "level", "cx", "cy").distinct(), []
    for k, blocks in full:
        at = [F.col("__name"), F.col("level"), F.col("cx"), F.floor(F.col("cy") / _BLOCK**k)]
        marked = blocks.select(F.struct("__name", "level", "cx", "cy").alias("__at"), F.lit(True).alias(f"__in{k}"))
        told = told.join(marked, F.struct(*[c.alias(n) for c, n in zip(at, ("__name", "level", "cx", "cy"))]) == F.col("__at"), "left").drop("__at")
        parts.append(F.coalesce(f"__in{k}", F.lit(False)))
    covered = reduce(lambda a, b: a | b, parts)
    return told.groupBy(*edge).agg(F.bool_and(covered).alias("__covered")).filter("__covered").select(*edge)


def _shapes(
    lines: DataFrame, polygons: DataFrame, keys: Sequence[str], name: str, cell: float, line: str, geometry: str
) -> _Shapes:
    shapes = polygons.select(F.col(name).alias("__name"), F.col(geometry).alias("__poly")).distinct()
    fine = cell / _FINE
    shapes = materialize(_fill_levels(shapes.withColumn("__shape", _shape_id("__poly")), "__poly", fine))
    edges = shapes.select("__shape", "__name", F.col("level").alias("__fill"), bbox("__poly").alias("__box"), F.explode(polygon_edges("__poly")).alias("__e"))
    edges = edges.select("__shape", "__name", "__fill", "__box", *_flat("__e", "e", "f"))
    edges = edges.withColumn("level", _level(F.greatest(F.abs(F.expr("fx - ex")), F.abs(F.expr("fy - ey"))), cell))
    known = edges.agg(F.collect_set("level").alias("level"), F.collect_set("__fill").alias("fill")).first()

    spark = lines.sparkSession
    lines = lines.select(*keys, line)
    held = _segments(lines, keys, line, cell).groupBy(F.spark_partition_id().alias("__at"), "level").agg(F.count(F.lit(1)).alias("n")).collect()
    tasks: Counter[int] = Counter()
    for r in held:
        tasks[r["__at"]] += r["n"]
    if max(tasks.values(), default=0) * spark.sparkContext.defaultParallelism > 2 * tasks.total():
        # narrow rows, much work on each: few tasks hold most of them, so they are dealt out
        lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    near = materialize(_covered(edges.drop("level"), _EDGE, "__fill", fine).withColumnRenamed("__fill", "level"))
    full, inside = _full_and_split(shapes, near, fine)
    border = edges.drop("__fill", "__shape", "__box").join(_hidden(near, full), ["__name", *_EDGE], "left_anti")
    right = segment_cover(border, _EDGE, _above({r["level"] for r in held if r["level"] is not None}), cell, 0, [0, 1])
    right = materialize(right.withColumnsRenamed({c: f"e_{c}" for c in ("slot", "cx", "cy")}))
    other = {"level": "e_at", "cx": "e_cx", "cy": "e_cy"}
    by_cell = materialize(_edges_by_cell(near, inside, fine).withColumnsRenamed(other))
    return _Shapes(lines, right, _above(known["level"]), sorted(known["fill"]), [(k, b.withColumnsRenamed(other)) for k, b in full], by_cell)


#: The slot in which every line meets the one edge that is no polygon's.
_NOWHERE = -1


def _extent(ends: Sequence[str], prefix: str) -> list[Column]:
    """The box of a segment, so that it is not made anew for each edge that it meets in a cell."""
    return [f(*ends[i::2]).alias(f"{prefix}__{c}{n}") for i, c in enumerate("xy") for n, f in enumerate((F.least, F.greatest))]


def _same_cell() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == F.col(f"e_{c}") for c in ("slot", "cx", "cy")])


def _place(slot: Column, cx: Column, cy: Column) -> Column:
    """A cell as one whole number: a join on it looks up faster than on three columns. Cells far apart may share it."""
    left = lambda c, by: F.call_function("shiftleft", c.cast("bigint"), F.lit(by))
    return left(cx, 32).bitwiseXOR(cy.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseXOR(left(slot, 56))


def _segments_touch() -> Column:
    return segments_touch(*[F.col(c) for c in (*_ENDS, *_EDGE)])


def _touches() -> Column:
    return _same_cell() & _segments_touch()


def _starts(lines: DataFrame, keys: Sequence[str], line: str, levels: Column, cell: float) -> DataFrame:
    """The first vertex of each line, once per level, with its cell, of those that tell starts."""
    start = F.get(line, F.lit(0))
    starts = lines.filter(F.size(line) > 0).select(*keys, start["x"].alias("px"), start["y"].alias("py"))
    return _start_cells(starts.withColumn("at", F.explode(levels)), cell)


def _start_cells(starts: DataFrame, cell: float) -> DataFrame:
    return starts.withColumns({f"c{c}": F.floor(F.col(f"p{c}") / _size("at", cell / _FINE)) for c in "xy"})


def _in_box(box: Column) -> Column:
    return F.col("px").between(box["xmin"], box["xmax"]) & F.col("py").between(box["ymin"], box["ymax"])


def _switched(first: Column, edges: Column, rx: Column, ry: Column) -> Column:
    """A start lies inside a polygon if its cell's reference point does, switched once per edge between the two."""
    cut = lambda e: F.coalesce(way_crosses_edge(F.col("px"), F.col("py"), rx, ry, e["ex"], e["ey"], e["fx"], e["fy"]), F.lit(False))
    return F.aggregate(edges, first, lambda odd, e: odd != cut(e))


def _beside() -> Column:
    here = (F.col("at") == F.col("e_at")) & (F.col("cx") == F.col("e_cx")) & (F.col("cy") == F.col("e_cy"))
    return here & _in_box(F.col("__box"))


def _by_votes(shapes: _Shapes, keys: Sequence[str], cell: float, line: str) -> DataFrame | None:
    """(line key, ``__name``) of the starts inside a polygon that are told in parts, in cells of many edges; None if there are no such cells."""
    crowded = shapes.by_cell.filter("__many")
    if crowded.isEmpty():
        return None
    owner = [*keys, "px", "py", "__name", "__shape"]
    cut = _switched(F.lit(False), F.col("__edges"), F.col("rx"), F.col("ry"))
    starts = _starts(shapes.lines, keys, line, shapes.fill_levels, cell)
    votes = starts.join(whole_if_small(crowded), _beside()).select(*owner, "__part", "__odd", cut.alias("__cut")).distinct()
    odd = votes.groupBy(*owner).agg(((F.count_if("__cut") + F.max(F.col("__odd").cast("int"))) % 2 == 1).alias("__is_in"))
    return odd.filter("__is_in").select(*keys, "__name")


def _meetings(
    lines: DataFrame, polygons: DataFrame, keys: Sequence[str], name: str, cell: float, line: str, geometry: str
) -> DataFrame:
    """(line key, ``__name``) of all that share a point, some of them more than once. See ``crosses``."""
    shapes = _shapes(lines, polygons, keys, name, cell, line, geometry)
    left = segment_cover(_segments(shapes.lines, keys, line, cell), _ENDS, shapes.edge_levels, cell, 1, [0])
    met = left.join(whole_if_small(shapes.edges), _touches()).select(*keys, "__name")
    starts = _starts(shapes.lines, keys, line, shapes.fill_levels, cell)
    for k, blocks in shapes.full:
        in_block = (F.col("at") == F.col("e_at")) & (F.col("cx") == F.col("e_cx")) & (F.floor(F.col("cy") / _BLOCK**k) == F.col("e_cy"))
        met = met.unionAll(starts.join(whole_if_small(blocks), in_block).select(*keys, "__name"))
    told = _switched(F.col("__odd"), F.col("__edges"), F.col("rx"), F.col("ry"))
    met = met.unionAll(starts.join(whole_if_small(shapes.by_cell.filter("NOT __many")), _beside() & told).select(*keys, "__name"))
    votes = _by_votes(shapes, keys, cell, line)
    return met if votes is None else met.unionAll(votes)


#: Polygon names that one whole number tells.
_BITS = 63


def _met_bits(
    lines: DataFrame, polygons: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], cell: float, line: str, geometry: str
) -> DataFrame:
    """Every line key, once, with ``__met``: a bit per name of what the key's lines meet.

    The starts come first: what they lie in is told from one row per cell, and a segment asks only for the names that are left.
    So a line goes through both joins in one pass, and a task sums its keys up before anything is shuffled.
    """
    shapes = _shapes(lines, polygons, keys, name, cell, line, geometry)
    nothing, everything = F.lit(0).cast("bigint"), F.lit(2 ** len(names) - 1).cast("bigint")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("__name")).cast("int") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)

    at_cell = ["e_k", "e_at", "e_cx", "e_cy"]
    few = shapes.by_cell.filter("NOT __many").select(
        F.lit(0).alias("e_k"), *at_cell[1:], nothing.alias("__bit"),
        F.struct(bit.alias("bit"), F.col("__box").alias("box"), "rx", "ry", F.col("__edges").alias("edges"), F.col("__odd").alias("odd")).alias("__few"),
    )
    for k, blocks in shapes.full:
        few = few.unionAll(blocks.select(F.lit(k).alias("e_k"), *at_cell[1:], bit.alias("__bit"), F.lit(None).cast(few.schema["__few"].dataType).alias("__few")))
    cells = few.groupBy(*at_cell).agg(F.bit_or("__bit").alias("__full"), F.collect_list("__few").alias("__few"))
    # no edges of what the cell decides alone
    left_over = F.filter("__few", lambda e: F.col("__full").bitwiseAND(e["bit"]) == 0)
    cells = whole_if_small(materialize(cells.withColumn("__few", F.when(F.size(left_over) > 0, left_over))))

    asks = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(k).alias("k")) for at in shapes.fills for k, _ in shapes.full]).cast("array<struct<at:int,k:int>>")
    start = F.get(line, F.lit(0))
    starts = shapes.lines.select(*keys, line, start["x"].alias("px"), start["y"].alias("py"), F.posexplode_outer(asks).alias("__no", "__ask"))
    starts = _start_cells(starts.select("*", "__ask.at", "__ask.k"), cell).withColumn("cy", F.floor(F.col("cy") / F.pow(F.lit(float(_BLOCK)), F.col("k"))))
    here = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"e_{c}") for c in ("k", "at", "cx", "cy")])

    def add(met: Column, s: Column) -> Column:
        news = (met.bitwiseAND(s["bit"]) == 0) & _in_box(s["box"]) & _switched(s["odd"], s["edges"], s["rx"], s["ry"])
        return F.when(news, met.bitwiseOR(s["bit"])).otherwise(met)

    known = starts.join(cells, here, "left").withColumn("__met", F.coalesce(F.when(F.col("__few").isNotNull(), F.aggregate("__few", F.col("__full"), add)).otherwise(F.col("__full")), nothing))
    owner = [*keys, "__met"]
    segments = _segments(known, owner, line, cell, unless=(F.col("__met") == everything) | (F.col("__no") > 0))
    # each segment also asks in a place of its own, where an edge of no polygon answers with no bit: every key is there, misses are not
    nowhere = F.struct(F.lit(None).cast("int").alias("at"), F.lit(_NOWHERE).alias("slot"))
    left = segment_cover(segments, _ENDS, shapes.edge_levels, cell, 1, [0], F.explode_outer, [nowhere])
    left = left.select(*owner, *_ENDS, *_extent(_ENDS, ""), _place(F.coalesce("slot", F.lit(_NOWHERE)), *[F.coalesce(c, F.lit(0)) for c in ("cx", "cy")]).alias("__at"))
    edges = shapes.edges.select(*_EDGE, *_extent(_EDGE, "e_"), _place(F.col("e_slot"), F.col("e_cx"), F.col("e_cy")).alias("e_at"), bit.alias("__bit"))
    none = lines.sparkSession.range(1).select(*[F.lit(None).cast("double")] * (len(edges.columns) - 2), _place(F.lit(_NOWHERE), F.lit(0), F.lit(0)), nothing)
    edges = whole_if_small(materialize(edges.unionAll(none)))
    near = [F.col(f"__{c}0") <= F.col(f"e___{c}1") for c in "xy"] + [F.col(f"e___{c}0") <= F.col(f"__{c}1") for c in "xy"]
    news = reduce(lambda a, b: a & b, [F.col("__met").bitwiseAND(F.col("__bit")) == 0, *near]) & _segments_touch()
    # two that share a number, but no cell, touch or they do not: the number only finds them
    touched = left.join(edges, (F.col("__at") == F.col("e_at")) & ((F.col("__bit") == nothing) | news))
    met = touched.select(*keys, F.col("__met").bitwiseOR(F.col("__bit")).alias("__met"))
    votes = _by_votes(shapes, keys, cell, line)
    if votes is not None:
        met = met.unionAll(votes.select(*keys, bit.alias("__met")))
    return met.groupBy(*keys).agg(F.bit_or("__met").alias("__met"))


def crosses(
    lines: DataFrame,
    polygons: DataFrame,
    keys: Sequence[str],
    name: str,
    cell: float,
    line: str = "geometry",
    geometry: str = "geometry",
) -> DataFrame:
    """Distinct (line key, polygon name) pairs that share a point. A key may own any number of line rows.

    A line meets a polygon if one of its segments touches an edge, or if it starts inside. Both tests look only at what meets
    in a cell of a quadtree and sit in the join condition, so a candidate that fails never becomes a row. ``cell`` is the
    size of the smallest cells. Segments and edges lie in cells of a level that suits their own length, tens of rows however
    long they are, and meet at the higher of both levels. The polygons' side is stored; if it is small it goes whole to where the
    lines are read, and only answers are shuffled. Lines are read in several passes: store them first if they are costly to make.
    """
    return _meetings(lines, polygons, list(keys), name, cell, line, geometry).distinct().withColumnRenamed("__name", name)


def crossing_flags(
    lines: DataFrame,
    polygons: DataFrame,
    keys: Sequence[str],
    name: str,
    flags: Mapping[str, str],
    cell: float,
    line: str = "geometry",
    geometry: str = "geometry",
) -> DataFrame:
    """One row per line key with one boolean per named polygon ``{flag column: polygon name}``, never missing."""
    names = list(dict.fromkeys(flags.values()))
    wanted = polygons.filter(F.col(name).isin(*names))
    if len(names) <= _BITS:
        met = _met_bits(lines, wanted, list(keys), name, names, cell, line, geometry)
        has = {k: F.getbit("__met", F.lit(names.index(v))) == 1 for k, v in flags.items()}
        return met.select(*keys, *[c.alias(k) for k, c in has.items()])
    met = _meetings(lines, wanted, list(keys), name, cell, line, geometry)
    # a row without a name per line: every key is there, in the same shuffle as the answers
    every = lines.select(*keys, F.lit(None).cast(met.schema["__name"].dataType).alias("__name"))
    is_met = {k: F.coalesce(F.bool_or(F.col("__name") == F.lit(v)), F.lit(False)) for k, v in flags.items()}
    return every.unionAll(met).groupBy(*keys).agg(*[c.alias(k) for k, c in is_met.items()])


# --- points and lines -----------------------------------------------------------------------------------------

def make_lines(df: DataFrame, keys: Sequence[str], order: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """Join the ordered points of each line id into one line (two points each for origin-destination pairs)."""
    pts = F.array_sort(F.collect_list(F.struct(*order, geometry)))
    return df.groupBy(*keys).agg(F.transform(pts, lambda p: p[geometry]).alias(geometry))


def zoom(
    df: DataFrame, center: DataFrame, half_width: float, x: str = "x", y: str = "y"
) -> DataFrame:
    """Rows within a square around one node; ``center`` is a one-row table with the same coordinate columns."""
    at = center.select(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).scalar()
    cx, cy = at.getField("x"), at.getField("y")
    return df.filter(
        F.col(x).between(cx - half_width, cx + half_width) & F.col(y).between(cy - half_width, cy + half_width)
    )
