"""Travel measures between chosen places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.functions.geometry import haversine_km
from odweave.functions.semantics import sort_keys
from odweave.operators.reshape import grid
from odweave.session import materialize, whole_if_small


Measure = Callable[[Column, Column, Column, Column], Column]


def od_matrix(
    places: DataFrame, measure: Measure = haversine_km, key: str = "GEOID", x: str = "lon", y: str = "lat", most: int = 30_000
) -> DataFrame:
    """Travel measure (great-circle distance unless given) between all pairs of the chosen places in long form.

    The full matrix is the result, so it is meant for a short list such as the ends of the top flows; more than ``most`` places
    are an error, not a shorter result.
    """
    if places.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} places: the matrix has a row per pair; raise `most` if that is wanted")

    def role(prefix: str) -> DataFrame:
        return places.select(*[F.col(c).alias(f"{prefix}_{n}") for c, n in ((key, key), (x, "x"), (y, "y"))])

    pairs = grid(role("origin"), role("destination"))
    km = measure(F.col("origin_x"), F.col("origin_y"), F.col("destination_x"), F.col("destination_y"))
    return pairs.select(f"origin_{key}", f"destination_{key}", km.alias("travel_km"))


def to_destination(places: DataFrame, dest: DataFrame, x: str = "lon", y: str = "lat", key: str = "GEOID") -> DataFrame:
    """All places to one destination (a one-row table), the farthest first."""
    at = dest.select(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).scalar()
    km = haversine_km(F.col(x), F.col(y), at.getField("x"), at.getField("y"))
    return places.withColumn("travel_km", km).orderBy(*sort_keys(["-travel_km", key]))


def _usable(roads: DataFrame, src: str, dst: str, cost: str) -> DataFrame:
    """Roads ``a, b, step`` with two different ends and a cost, which must not be negative."""
    a, b, step = (F.col(c).alias(n) for c, n in ((src, "a"), (dst, "b"), (cost, "step")))
    checked = F.when(F.col("step") < 0, F.raise_error(F.lit("negative cost of a road"))).otherwise(F.col("step"))
    return roads.select(a, b, step).dropna().withColumn("step", checked).filter("a <> b")


def _kind(roads: DataFrame) -> str:
    """Type of summed costs."""
    return "bigint" if roads.schema["step"].dataType.typeName() in ("byte", "short", "integer", "long") else "double"


def least_costs(
    roads: DataFrame, origins: DataFrame, src: str = "from", dst: str = "to", cost: str = "cost", key: str = "name",
    both_ways: bool = False, most: float | None = None,
) -> DataFrame:
    """Least cost of a way from every origin to every node it reaches, at most ``most`` away: origin, node, cost.

    Each round only extends the ways that the round before has found or made cheaper; rounds are as many as the roads of the
    longest cheapest way, and what is kept is one row per origin and reached node. Of parallel roads the cheapest counts; a
    road without an end or a cost leads nowhere; a missing origin is left out, a repeated one counts once; an origin that no
    road touches reaches itself. A negative cost is an error.
    """
    open_roads = _usable(roads, src, dst, cost)
    if both_ways:
        open_roads = open_roads.unionByName(open_roads.select(F.col("b").alias("a"), F.col("a").alias("b"), "step"))
    open_roads = materialize(open_roads.groupBy("a", "b").agg(F.min("step").alias("step")))
    kind = _kind(open_roads)
    start = origins.select(F.col(key).alias("origin"), F.col(key).alias("node")).dropna().distinct()
    reached = materialize(start.select("origin", "node", F.lit(0).cast(kind).alias("cost"), F.lit(True).alias("cheaper")))
    while not reached.filter("cheaper").isEmpty():
        ways = reached.filter("cheaper").join(open_roads, F.col("node") == F.col("a"))
        found = ways.select("origin", F.col("b").alias("node"), (F.col("cost") + F.col("step")).cast(kind).alias("found"))
        if most is not None:
            found = found.filter(F.col("found") <= most)
        known = reached.select("origin", "node", F.col("cost").alias("known"))
        best = known.unionByName(found, allowMissingColumns=True).groupBy("origin", "node").agg(F.min("known").alias("known"), F.min("found").alias("found"))
        cheaper = F.coalesce(F.col("found") < F.col("known"), F.col("known").isNull())
        reached = materialize(best.select("origin", "node", F.least("known", "found").alias("cost"), cheaper.alias("cheaper")))
    return reached.select("origin", "node", "cost")


#: Places up to which the matrix is searched from both ends; the meetings of all pairs at a node are as many as their square.
_FEW_PLACES = 100


def _meeting_costs(
    roads: DataFrame, places: DataFrame, src: str = "from", dst: str = "to", cost: str = "cost", both_ways: bool = False, most: float | None = None
) -> DataFrame:
    """Least costs between all pairs of few ``places`` (column ``place``) that a way joins: origin, node, cost.

    Ways grow out of every origin, and backwards out of every destination, up to a radius; what lies beyond is kept, but not
    followed. A cheapest way of at most twice the radius has a node that is near one end and one road or none off the other's
    near ones, so a sum of both costs up to that is final. The radius grows until every pair has a final cost, or an end from which all
    is seen. So only the surroundings of the places are searched, not all that they reach.
    """
    open_roads = _usable(roads, src, dst, cost)
    if both_ways:
        # a road is kept once and followed either way
        open_roads = open_roads.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "step")
    open_roads = materialize(open_roads.groupBy("a", "b").agg(F.min("step").alias("step")))
    kind, label = _kind(open_roads), ["back", "place", "node"]
    sides = [False] if both_ways else [False, True]
    back = F.explode(F.array(*[F.lit(side) for side in sides])).alias("back")
    labels = places.select(back, "place", F.col("place").alias("node"), F.lit(0).cast(kind).alias("cost"), F.lit(True).alias("new"))
    labels = materialize(labels)
    names = [r["place"] for r in places.collect()]
    left = {(o, d) for o in names for d in names}
    best: dict[tuple, float] = {}
    radius = 0
    while left:
        busy = [{o for o, _ in left}, {d for _, d in left}]
        if both_ways:
            busy[0] |= busy[1]
        active = F.lit(False)
        for side in sides:
            active = active | ((F.col("back") == F.lit(side)) & F.col("place").isin(*busy[side]))
        near = F.col("new") & (F.col("cost") <= F.lit(radius)) & active
        while not (ahead := labels.filter(near)).isEmpty():
            ahead = whole_if_small(ahead.drop("new"))
            found = None
            for at, to, side in (("a", "b", False), ("b", "a", True)):
                own = ahead if both_ways else ahead.filter(F.col("back") == F.lit(side))
                ways = open_roads.join(own, F.col(at) == F.col("node"))
                ways = ways.select("back", "place", F.col(to).alias("node"), (F.col("cost") + F.col("step")).cast(kind).alias("found"))
                found = ways if found is None else found.unionByName(ways)
            if most is not None:
                found = found.filter(F.col("found") <= most)
            known = labels.select(*label, F.col("cost").alias("known"), (F.col("new") & ~near).alias("new"))
            merged = known.unionByName(found, allowMissingColumns=True).groupBy(*label)
            merged = merged.agg(F.min("known").alias("known"), F.min("found").alias("found"), F.coalesce(F.bool_or("new"), F.lit(False)).alias("new"))
            cheaper = F.coalesce(F.col("found") < F.col("known"), F.col("known").isNull())
            labels = materialize(merged.select(*label, F.least("known", "found").alias("cost"), (cheaper | F.col("new")).alias("new")))
        out = labels.filter("NOT back").select(F.col("place").alias("origin"), "node", "cost")
        home = labels.filter(F.col("back") == F.lit(not both_ways)).filter(F.col("cost") <= F.lit(radius))
        home = home.select(F.col("place").alias("destination"), F.col("node").alias("at"), F.col("cost").alias("rest"))
        met = out.join(home, F.col("node") == F.col("at")).groupBy("origin", "destination").agg(F.min(F.col("cost") + F.col("rest")).alias("cost"))
        best |= {(r["origin"], r["destination"]): r["cost"] for r in met.collect()}
        more = {(r["back"], r["place"]): r["next"] for r in labels.filter("new").groupBy("back", "place").agg(F.min("cost").alias("next")).collect()}
        left = {
            (o, d) for o, d in left
            if best.get((o, d), float("inf")) > 2 * radius and (False, o) in more and (not both_ways, d) in more
        }
        if left:
            bound = max(best.get(pair, float("inf")) for pair in left) / 2
            following = min(min(more[False, o], more[not both_ways, d]) for o, d in left)
            radius = max(following, min(2 * radius, bound))
    rows = [(o, d, c) for (o, d), c in best.items() if most is None or c <= most]
    kinds = places.schema["place"].dataType.simpleString()
    return places.sparkSession.createDataFrame(rows, f"origin {kinds}, node {kinds}, cost {kind}")


def network_matrix(roads: DataFrame, places: DataFrame, key: str = "name", **ways) -> DataFrame:
    """Least cost over a network between all pairs of the chosen places in long form; missing where no way leads.

    ``ways`` are as in ``least_costs``. Like ``od_matrix`` it is meant for a short list of places; the network may be of any size. Up to
    ``_FEW_PLACES`` places the search goes from both ends and ends when all pairs are known; costs that are doubles are then
    sums of two halves.
    """
    chosen = materialize(places.select(key).dropna().distinct())
    pairs = grid(chosen.select(F.col(key).alias(f"origin_{key}")), chosen.select(F.col(key).alias(f"destination_{key}")))
    if chosen.count() <= _FEW_PLACES:
        reached = _meeting_costs(roads, chosen.withColumnRenamed(key, "place"), **ways)
    else:
        reached = least_costs(roads, chosen, key=key, **ways)
    same = (F.col("origin") == F.col(f"origin_{key}")) & (F.col("node") == F.col(f"destination_{key}"))
    return pairs.join(reached, same, "left").select(f"origin_{key}", f"destination_{key}", F.col("cost").alias("travel_cost"))
