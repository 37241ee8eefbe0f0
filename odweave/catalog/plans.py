"""The end-to-end studies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import CELL, Tables
from odweave.catalog.model import _hash
from odweave.catalog.registry import query
from odweave.catalog.spatial import _CROSS
from odweave.operators.joins import join
from odweave.operators.spatial import crossing_flags
from odweave.operators.verbs import agg_top_k
from odweave.plans.duration_model import duration_model
from odweave.plans.flow_summary import area_balance, main_network, top_area_pairs
from odweave.plans.route_study import study_routes
from odweave.session import materialize_in_parts


@query("plan_top_area_pairs", "SELECT h_tract, w_tract, commuters FROM flows_area WHERE h_tract <> w_tract")
def plan_top_area_pairs(t: Tables) -> DataFrame:
    ends = {"h_geocode": "h_tract", "w_geocode": "w_tract"}
    return top_area_pairs(t.flows_block, t.crosswalk, "tabblk2010", "trct", ends, areas=t.areas)


@query(
    "plan_area_balance",
    "WITH f AS (SELECT * FROM flows_area WHERE h_tract <> w_tract) SELECT GEOID, NAME, STATEFP, commuters_out, coalesce(commuters_in, 0) AS commuters_in,"
    " coalesce(commuters_in, 0) - commuters_out AS diff FROM areas"
    " LEFT JOIN (SELECT w_tract, CAST(sum(commuters) AS BIGINT) AS commuters_in FROM f GROUP BY 1) i ON GEOID = w_tract"
    " LEFT JOIN (SELECT h_tract, CAST(sum(commuters) AS BIGINT) AS commuters_out FROM f GROUP BY 1) o ON GEOID = h_tract",
)
def plan_area_balance(t: Tables) -> DataFrame:
    return area_balance(t.areas, t.flows_area, "h_tract", "w_tract")


@query(
    "plan_main_network",
    'SELECT h_geocode AS "from", w_geocode AS "to", commuters, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y FROM flows_pair'
    " LEFT JOIN points a ON h_geocode = a.vec_id LEFT JOIN points b ON w_geocode = b.vec_id WHERE commuters > 60 AND h_geocode <> w_geocode",
)
def plan_main_network(t: Tables) -> DataFrame:
    return main_network(t.flows_pair, "h_geocode", "w_geocode", t.points.withColumnRenamed("vec_id", "GEOID"), 60).edges_df


def _directions() -> Callable[[str, str, int], list[dict]]:
    """A stand-in for a routing service; made inside a function, it travels to the workers by value."""

    def steps(home: str, work: str, duration: int) -> list[dict]:
        if home == "1-URGENT":
            raise ValueError("bad address")
        if work == "P":
            raise LookupError("no route")
        half = float(duration // 2)
        return [{"distance": 2.0 * half, "duration": half, "instructions": "out"}, {"distance": 1.0, "duration": duration - half, "instructions": "in"}]

    return steps


@query(
    "plan_route_study",
    "SELECT h_tract, w_tract, CASE WHEN home_address = '1-URGENT' THEN '2-HIGH' ELSE home_address END AS home_address, work_address,"
    " CAST(duration AS DOUBLE) AS total, 2.0::DOUBLE * (duration // 2) + 1 AS distance, CAST(2 AS BIGINT) AS steps, commuters FROM routes WHERE work_address <> 'P'",
)
def plan_route_study(t: Tables) -> DataFrame:
    """Routes asked for, the failed ones repaired and asked again, then summed up."""
    routes = t.routes.select("h_tract", "w_tract", "home_address", "work_address", "duration", "commuters")
    asked = routes.withColumnRenamed("duration", "minutes")
    study = study_routes(
        asked, _directions(), ["home_address", "work_address", "minutes"], patches={"home_address": {"1-URGENT": "2-HIGH"}}
    )
    return study.stats.select(
        "h_tract", "w_tract", "home_address", "work_address", F.col("duration").alias("total"), "distance", "steps", "commuters"
    )


# Predictors made orthogonal one after another on the training part, so that each coefficient stands alone.
_ORTHOGONAL = (
    "r AS (SELECT h_tract, w_tract, CAST(duration AS DOUBLE) AS y, CAST(distance AS DOUBLE) AS x1, CAST(steps AS DOUBLE) AS x2,"
    " CAST(coalesce(f.f1, 0) AS DOUBLE) AS x3, CAST(coalesce(f.f2, 0) AS DOUBLE) AS x4, {train} AS fits FROM routes LEFT JOIN"
    " (SELECT l_orderkey, max((rank = 1)::int) AS f1, max((rank = 2)::int) AS f2 FROM met GROUP BY 1) f ON f.l_orderkey = w_tract),"
    " o1 AS (SELECT *, x1 - avg(x1) {on} AS z1 FROM r),"
    " o2 AS (SELECT *, x2 - avg(x2) {on} - coalesce(regr_slope(x2, z1) {on}, 0) * z1 AS z2 FROM o1),"
    " o3 AS (SELECT *, x3 - avg(x3) {on} - coalesce(regr_slope(x3, z1) {on}, 0) * z1 - coalesce(regr_slope(x3, z2) {on}, 0) * z2 AS z3 FROM o2),"
    " o4 AS (SELECT *, x4 - avg(x4) {on} - coalesce(regr_slope(x4, z1) {on}, 0) * z1 - coalesce(regr_slope(x4, z2) {on}, 0) * z2"
    " - coalesce(regr_slope(x4, z3) {on}, 0) * z3 AS z4 FROM o3),"
    " fitted AS (SELECT *, avg(y) {on} + "
    + " + ".join(f"coalesce(regr_slope(y, z{k}) {{on}}, 0) * z{k}" for k in range(1, 5))
    + " AS pred FROM o4)"
).format(train=f"{_hash('split-1234', 10000)} < 7500", on="FILTER (WHERE fits) OVER ()")


#: Steps in which orders, lines and flags are joined: each shuffles its part of the orders only, and reads the tables once more.
_PARTS = 2


@query(
    "plan_duration_model",
    f"WITH {_CROSS}, {_ORTHOGONAL} SELECT h_tract, w_tract, round(pred, 5) AS pred, round(y - pred, 5) AS resid FROM fitted",
)
def plan_duration_model(t: Tables) -> DataFrame:
    """Durations by distance, steps, and which of the two largest rivers a route crosses.

    A third flag, of a river that is not there, is the same for all routes; the recipe drops it.
    """
    rivers = [row["FULLNAME"] for row in agg_top_k(t.water, "FULLNAME", "AWATER", 2).collect()]
    names = {"first": rivers[0], "second": rivers[1], "dry": "no such river"}
    flags = crossing_flags(t.step_lines, t.water, ["l_orderkey"], "FULLNAME", names, CELL)
    routes = t.routes.select("h_tract", "w_tract", F.col("distance").cast("double").alias("distance"), "steps", "duration")
    flagged = join(routes, flags, {"w_tract": "l_orderkey"}, na_matches="never")
    flagged = materialize_in_parts(flagged.withColumns({n: F.coalesce(n, F.lit(False)).cast("double") for n in names}), ["w_tract"], _PARTS)
    features = ("distance", "steps", *names)
    model = duration_model(flagged, t.blocks.withColumnRenamed("NAME", "area_name"), features, key=("w_tract",), stored=True)
    return model.predictions.select("h_tract", "w_tract", F.round("`.pred`", 5).alias("pred"), F.round("`.resid`", 5).alias("resid"))
