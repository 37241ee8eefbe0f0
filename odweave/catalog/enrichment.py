"""Row by row enrichment, with a small local function in place of a web service."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.functions.geometry import point
from odweave.operators import enrichment as e
from odweave.operators.reshape import unnest

_LEG = T.StructType([T.StructField("leg", T.LongType()), T.StructField("minutes", T.LongType())])


def _directions() -> Callable[[str, str, int], list[dict]]:
    """The stand-in service. Made inside a function, it travels to the workers by value."""

    def legs(home: str, work: str, duration: int) -> list[dict]:
        if home == "1-URGENT":
            raise ValueError("bad address")
        if work == "P":
            raise LookupError("no route")
        return [{"leg": 1, "minutes": duration // 2}, {"leg": 2, "minutes": duration - duration // 2}]

    return legs


def _check_digit() -> Callable[[str], int]:
    """A sum that depends on the place of each letter, as a check digit does; made inside a function, as above."""

    def digit(text: str) -> int:
        return sum(i * ord(c) for i, c in enumerate(text, 1)) % 97

    return digit


@query(
    "udf_map",
    "SELECT w_tract, l_linenumber, l_partkey, CAST(list_sum(list_transform(range(1, length(instructions) + 1),"
    " lambda i: i * ascii(substr(instructions, i, 1)))) % 97 AS BIGINT) AS n FROM steps_named",
)
def udf_map(t: Tables) -> DataFrame:
    named = t.steps_named.select("w_tract", "l_linenumber", "l_partkey", "instructions")
    return e.map_column(named, _check_digit(), "instructions", "bigint", "n").drop("instructions")


@query(
    "udf_map2",
    "SELECT w_tract, leg, CASE leg WHEN 1 THEN duration // 2 ELSE duration - duration // 2 END AS minutes FROM routes,"
    " (SELECT CAST(unnest([1, 2]) AS BIGINT) AS leg) l WHERE home_address <> '1-URGENT' AND work_address <> 'P'",
)
def udf_map2(t: Tables) -> DataFrame:
    routes = t.routes.select("w_tract", "home_address", "work_address", "duration")
    called = e.map_rows(routes, _directions(), ["home_address", "work_address", "duration"], _LEG, "legs")
    return unnest(called.select("w_tract", "legs"), "legs")


@query(
    "udf_possibly",
    "SELECT w_tract, CASE WHEN home_address = '1-URGENT' OR work_address = 'P' THEN 'failed' ELSE 'ok' END AS status,"
    " CASE WHEN home_address = '1-URGENT' THEN 'ValueError: bad address' WHEN work_address = 'P' THEN 'LookupError: no route' END AS error FROM routes",
)
def udf_possibly(t: Tables) -> DataFrame:
    routes = t.routes.select("w_tract", "home_address", "work_address", "duration")
    called = e.possibly(routes, _directions(), ["home_address", "work_address", "duration"], T.ArrayType(_LEG), "legs")
    return called.select("w_tract", "status", "error")


_RETRIED = (
    "SELECT w_tract, CASE WHEN home_address = '1-URGENT' THEN '2-HIGH' ELSE home_address END AS home_address,"
    " CASE WHEN work_address = 'P' THEN 'failed' ELSE 'ok' END AS status,"
    " CASE WHEN home_address = '1-URGENT' OR work_address = 'P' THEN 'retried' ELSE 'main' END AS source_file,"
    " CASE WHEN work_address <> 'P' THEN CAST(2 AS INTEGER) END AS legs FROM routes"
)


@query("enrich_with_retry", _RETRIED)
def enrich_with_retry(t: Tables) -> DataFrame:
    routes = t.routes.select("w_tract", "home_address", "work_address", "duration")
    done = e.enrich(
        routes, _directions(), ["home_address", "work_address", "duration"], T.ArrayType(_LEG), "legs",
        patches={"home_address": {"1-URGENT": "2-HIGH"}},
    )
    legs = F.when(F.col("legs").isNotNull(), F.size("legs"))
    return done.select("w_tract", "home_address", "status", "source_file", legs.alias("legs"))


def _silent() -> Callable[..., list[dict]]:
    """A service that is down; made inside a function, as above."""

    def down(*_: object) -> list[dict]:
        raise ConnectionError("the service is down")

    return down


@query("enrich_resumed", _RETRIED)
def enrich_resumed(t: Tables) -> DataFrame:
    """The run is repeated while the service is down: all answers, failures too, come from the attempt log of the first run."""
    routes = t.routes.select("w_tract", "home_address", "work_address", "duration")
    log = t.scratch(f"attempts/{uuid4().hex}")
    for service in (_directions(), _silent()):
        done = e.enrich(
            routes, service, ["home_address", "work_address", "duration"], T.ArrayType(_LEG), "legs",
            patches={"home_address": {"1-URGENT": "2-HIGH"}}, log=log,
        )
    legs = F.when(F.col("legs").isNotNull(), F.size("legs"))
    return done.select("w_tract", "home_address", "status", "source_file", legs.alias("legs"))


@query("failure_report", "SELECT CAST(sum(CAST(floor(o_totalprice / 10000) AS BIGINT)) AS BIGINT) AS commuters FROM orders WHERE o_orderstatus = 'P'")
def failure_report(t: Tables) -> DataFrame:
    return e.failure_report(t.route_nested, "directions", "commuters")


@query(
    "retry_inputs",
    "SELECT o_custkey AS h_tract, o_orderkey AS w_tract, a.x AS h_x, b.x AS w_x, CAST(floor(o_totalprice / 10000) AS BIGINT) AS commuters"
    " FROM orders LEFT JOIN points a ON o_custkey = a.vec_id LEFT JOIN points b ON o_orderkey = b.vec_id WHERE o_orderstatus = 'P'",
)
def retry_inputs(t: Tables) -> DataFrame:
    _, failed = e.split_failures(t.route_nested, "directions", ["h_tract", "w_tract"])
    places = t.points.select("vec_id", point("x", "y").alias("at"))
    flows = t.route_nested.select("h_tract", "w_tract", "commuters")
    out = e.retry_inputs(failed, places, flows, "h_tract", "w_tract", "vec_id", "at")
    return out.select("h_tract", "w_tract", F.col("h_tract_geo.x").alias("h_x"), F.col("w_tract_geo.x").alias("w_x"), "commuters")


@query(
    "road_flags",
    "SELECT DISTINCT h_tract, w_tract, commuters, road AS intersects FROM steps_named, (VALUES ('red'), ('small'), ('ring')) r(road)"
    " WHERE contains(instructions, road)",
)
def road_flags(t: Tables) -> DataFrame:
    return e.routes_using(t.steps_named, {"red": "red", "small": "small", "ring": "ring"})
