"""The flow analyses' input shapes, derived from the driver's tables, in Spark and in SQL.

A flow is an order line: the customer is the home block, the supplier the work block, the quantity the job count.
Nations are the coarse areas. An order is a route and its lines are the steps. Embedding vectors give coordinates.
"""

from __future__ import annotations

import re
from functools import cached_property
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.functions.geometry import box, point, polygon, ring
from odweave.operators.aggregates import route_stats, sum_by, summarize_flows
from odweave.operators.joins import join
from odweave.session import scratch_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

CELL = 0.02
ROUTE = ["h_tract", "home_address", "w_tract", "work_address"]


def l_shape(x: Column, y: Column, s: Column) -> Column:
    """L of three squares of side ``s`` with its corner at (x, y)."""
    return polygon(
        ring(
            point(x, y), point(x + s * 2, y), point(x + s * 2, y + s), point(x + s, y + s), point(x + s, y + s * 2),
            point(x, y + s * 2),
        )
    )


class Tables:
    """Lazy access to the parquet tables of one folder and to the shapes derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, f"{PurePosixPath(self.sf_dir).name}/{name}")

    # --- flows -----------------------------------------------------------------------------------------------
    @cached_property
    def flows_block(self) -> DataFrame:
        lines = self.lineitem.select("l_orderkey", "l_suppkey", "l_quantity")
        orders = self.orders.select("o_orderkey", "o_custkey")
        return join(lines, orders, by={"l_orderkey": "o_orderkey"}, how="inner", na_matches="never").select(
            F.col("o_custkey").alias("h_geocode"),
            F.col("l_suppkey").alias("w_geocode"),
            F.col("l_quantity").cast("bigint").alias("S000"),
        )

    @cached_property
    def flows_pair(self) -> DataFrame:
        return sum_by(self.flows_block, ["h_geocode", "w_geocode"], "S000", out="commuters")

    @cached_property
    def crosswalk(self) -> dict[str, DataFrame]:
        """One crosswalk per role, as home and work codes come from different tables."""
        return {
            "h_geocode": self.customer.select(F.col("c_custkey").alias("tabblk2010"), F.col("c_nationkey").alias("trct")),
            "w_geocode": self.supplier.select(F.col("s_suppkey").alias("tabblk2010"), F.col("s_nationkey").alias("trct")),
        }

    @cached_property
    def flows_area(self) -> DataFrame:
        return summarize_flows(
            self.flows_block, self.crosswalk, "tabblk2010", "trct", {"h_geocode": "h_tract", "w_geocode": "w_tract"}
        )

    @cached_property
    def areas(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").alias("GEOID"), F.col("n_name").alias("NAME"), F.col("n_regionkey").alias("STATEFP")
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """Home blocks as areas of their own."""
        return self.customer.select(
            F.col("c_custkey").alias("GEOID"), F.col("c_name").alias("NAME"), F.col("c_mktsegment").alias("segment")
        )

    @cached_property
    def county_flows(self) -> DataFrame:
        """Flows of every block pair with both states, for multi-state work (county = 5-digit text code)."""
        h, w = self.customer, self.supplier
        nation = self.nation.select("n_nationkey", "n_regionkey")
        flows = self.flows_block
        home = join(h.select("c_custkey", "c_nationkey"), nation, {"c_nationkey": "n_nationkey"}, na_matches="never")
        work = join(w.select("s_suppkey", "s_nationkey"), nation, {"s_nationkey": "n_nationkey"}, na_matches="never")
        home = home.select(
            F.col("c_custkey").alias("h_geocode"), F.col("n_regionkey").alias("h_state"),
            F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("0000")).alias("h_block"),
        )
        work = work.select(
            F.col("s_suppkey").alias("w_geocode"), F.col("n_regionkey").alias("w_state"),
            F.concat(F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit("0000")).alias("w_block"),
        )
        flows = join(join(flows, home, "h_geocode", "inner", "never"), work, "w_geocode", "inner", "never")
        region = self.region.select(F.col("r_regionkey").alias("w_state"), F.lower(F.regexp_replace("r_name", " ", "")).alias("state"))
        return join(flows, region, "w_state", "inner", "never").select(
            "state",
            F.when(F.col("h_state") == F.col("w_state"), F.lit("main")).otherwise(F.lit("aux")).alias("part"),
            F.col("w_block").alias("w_geocode"), F.col("h_block").alias("h_geocode"), "S000",
        )

    @cached_property
    def counties(self) -> DataFrame:
        k, r = F.col("n_nationkey"), F.col("n_regionkey")
        return self.nation.select(
            F.concat(F.lpad(k.cast("string"), 2, "0"), F.lit("000")).alias("GEOID"),
            F.col("n_name").alias("NAME"),
            r.alias("STATEFP"),
            l_shape(k * 3.0 - 100, r * 4.0 + 20, k * 0.1 + 1).alias("geometry"),
        )

    @cached_property
    def states(self) -> DataFrame:
        return self.region.select(F.col("r_regionkey").alias("state_code"), F.col("r_name").alias("state_name"))

    # --- routes ----------------------------------------------------------------------------------------------
    @cached_property
    def steps(self) -> DataFrame:
        """One row per step of a route, amounts as decimals so that sums are exact."""
        lines = self.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
        )
        joined = join(lines, self.orders, by={"l_orderkey": "o_orderkey"}, how="inner", na_matches="never")
        return joined.select(
            F.col("o_custkey").alias("h_tract"),
            F.col("o_orderpriority").alias("home_address"),
            F.col("l_orderkey").alias("w_tract"),
            F.col("o_orderstatus").alias("work_address"),
            F.col("l_quantity").cast("bigint").alias("duration"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("distance"),
            F.floor(F.col("o_totalprice") / 10000).cast("bigint").alias("commuters"),
            "l_linenumber", "l_partkey", "l_suppkey",
        )

    @cached_property
    def steps_named(self) -> DataFrame:
        part = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("instructions"))
        return join(self.steps, part, by="l_partkey", how="inner", na_matches="never")

    @cached_property
    def routes(self) -> DataFrame:
        return route_stats(self.steps, ROUTE)

    @cached_property
    def trips(self) -> DataFrame:
        """Every order line as a trip between two nations."""
        lines = self.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
        orders = self.orders.select("o_orderkey", "o_custkey")
        cust = self.customer.select("c_custkey", "c_nationkey")
        supp = self.supplier.select("s_suppkey", "s_nationkey")
        df = join(lines, orders, {"l_orderkey": "o_orderkey"}, "inner", "never")
        df = join(df, cust, {"o_custkey": "c_custkey"}, "inner", "never")
        df = join(df, supp, {"l_suppkey": "s_suppkey"}, "inner", "never")
        return df.select(
            F.col("c_nationkey").alias("h_tract"), F.col("s_nationkey").alias("w_tract"),
            F.col("l_quantity").cast("bigint").alias("duration"), F.col("l_linenumber").cast("bigint").alias("commuters"),
        )

    @cached_property
    def route_nested(self) -> DataFrame:
        """Orders as routes with their steps as an array, one step per priority level; a pending order has none, as a
        failed call would leave it."""
        price = F.floor(F.col("o_totalprice") / 10000).cast("bigint")
        n = F.substring("o_orderpriority", 1, 1).cast("bigint")
        steps = F.transform(
            F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.struct(i.alias("step"), (i * price).alias("duration"))
        )
        return self.orders.select(
            F.col("o_custkey").alias("h_tract"),
            F.col("o_orderkey").alias("w_tract"),
            price.alias("commuters"),
            F.when(F.col("o_orderstatus") != "P", steps).alias("directions"),
        )

    # --- space -----------------------------------------------------------------------------------------------
    def _dim(self, i: int) -> Column:
        return F.col("embedding").getItem(i).cast("double")

    @cached_property
    def points(self) -> DataFrame:
        return self.embeddings.select("vec_id", "label", self._dim(0).alias("x"), self._dim(1).alias("y"))

    @cached_property
    def plots(self) -> DataFrame:
        """An L-shaped polygon per vector."""
        side = F.abs(self._dim(2)) * 0.1 + 0.01
        return self.embeddings.select("vec_id", "label", l_shape(self._dim(0), self._dim(1), side).alias("geometry"))

    @cached_property
    def water(self) -> DataFrame:
        """A rectangle per vector, named after its label."""
        x, y = self._dim(3), self._dim(4)
        w, h = F.abs(self._dim(5)) * 0.2 + 0.01, F.abs(self._dim(6)) * 0.1 + 0.01
        return self.embeddings.select(
            F.concat(F.lit("River "), F.col("label").cast("string")).alias("FULLNAME"),
            F.round(w * h * 1e9).cast("bigint").alias("AWATER"),
            box(x, y, x + w, y + h).alias("geometry"),
        )

    @cached_property
    def zones(self) -> DataFrame:
        """Bounding box of the points of each label."""
        b = self.points.groupBy("label").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).toDF("zone", "x0", "y0", "x1", "y1")
        return b.select("zone", box("x0", "y0", "x1", "y1").alias("geometry"))

    @cached_property
    def step_lines(self) -> DataFrame:
        """Every order line as a straight line; an order's lines form its route."""
        a = point(F.col("l_extendedprice") / 200000 - 0.25, F.col("l_quantity") / 100 - 0.25)
        b = point(F.col("l_extendedprice") / 200000 - 0.25 + F.col("l_discount"), F.col("l_quantity") / 100 - 0.25 + F.col("l_tax"))
        return self.lineitem.select("l_orderkey", F.array(a, b).alias("geometry"))


_L_CELLS = (
    "SELECT {ids}, i AS cx, j AS cy FROM (SELECT *, unnest(range(CAST(ceil(x / 0.02 - 0.5) AS BIGINT),"
    " CAST(ceil((x + s * 2) / 0.02 - 0.5) AS BIGINT))) AS i FROM {t}) q,"
    " LATERAL (SELECT unnest(range(CAST(ceil(y / 0.02 - 0.5) AS BIGINT), CAST(ceil("
    "(CASE WHEN (i + 0.5) * 0.02 < x + s THEN y + s * 2 ELSE y + s END) / 0.02 - 0.5) AS BIGINT))) AS j) c"
)

FIXTURE_SQL: dict[str, str] = {
    "flows_block": "SELECT o_custkey AS h_geocode, l_suppkey AS w_geocode, CAST(l_quantity AS BIGINT) AS S000"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "flows_pair": "SELECT h_geocode, w_geocode, CAST(sum(S000) AS BIGINT) AS commuters FROM flows_block GROUP BY ALL",
    "flows_area": "SELECT c_nationkey AS h_tract, s_nationkey AS w_tract, CAST(sum(commuters) AS BIGINT) AS commuters"
    " FROM flows_pair LEFT JOIN customer ON h_geocode = c_custkey LEFT JOIN supplier ON w_geocode = s_suppkey GROUP BY ALL",
    "areas": "SELECT n_nationkey AS GEOID, n_name AS NAME, n_regionkey AS STATEFP FROM nation",
    "blocks": "SELECT c_custkey AS GEOID, c_name AS NAME, c_mktsegment AS segment FROM customer",
    "county_flows": "SELECT lower(replace(r_name, ' ', '')) AS state,"
    " CASE WHEN hn.n_regionkey = wn.n_regionkey THEN 'main' ELSE 'aux' END AS part,"
    " lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '0000' AS w_geocode,"
    " lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '0000' AS h_geocode, S000"
    " FROM flows_block JOIN customer ON h_geocode = c_custkey JOIN supplier ON w_geocode = s_suppkey"
    " JOIN nation hn ON c_nationkey = hn.n_nationkey JOIN nation wn ON s_nationkey = wn.n_nationkey"
    " JOIN region ON wn.n_regionkey = r_regionkey",
    "counties": "SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '000' AS GEOID, n_name AS NAME, n_regionkey AS STATEFP,"
    " n_nationkey * CAST(3 AS DOUBLE) - 100 AS x, n_regionkey * CAST(4 AS DOUBLE) + 20 AS y,"
    " n_nationkey * CAST(0.1 AS DOUBLE) + 1 AS s FROM nation",
    "states": "SELECT r_regionkey AS state_code, r_name AS state_name FROM region",
    "steps": "SELECT o_custkey AS h_tract, o_orderpriority AS home_address, l_orderkey AS w_tract, o_orderstatus AS work_address,"
    " CAST(l_quantity AS BIGINT) AS duration, CAST(l_extendedprice AS DECIMAL(18,2)) AS distance,"
    " CAST(floor(o_totalprice / 10000) AS BIGINT) AS commuters, l_linenumber, l_partkey, l_suppkey"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "steps_named": "SELECT steps.*, p_name AS instructions FROM steps JOIN part ON l_partkey = p_partkey",
    "routes": "SELECT h_tract, home_address, w_tract, work_address, CAST(sum(duration) AS BIGINT) AS duration,"
    " CAST(sum(distance) AS DOUBLE) AS distance, count(*) AS steps, min(commuters) AS commuters FROM steps GROUP BY ALL",
    "trips": "SELECT c_nationkey AS h_tract, s_nationkey AS w_tract, CAST(l_quantity AS BIGINT) AS duration,"
    " CAST(l_linenumber AS BIGINT) AS commuters FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey",
    "points": "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings",
    "plots": "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,"
    " abs(CAST(embedding[3] AS DOUBLE)) * CAST(0.1 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS s FROM embeddings",
    "plot_cells": _L_CELLS.format(ids="vec_id, label", t="plots"),
    "water": "SELECT 'River ' || CAST(label AS VARCHAR) AS FULLNAME, CAST(round(w * h * 1e9) AS BIGINT) AS AWATER,"
    " x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM (SELECT label, CAST(embedding[4] AS DOUBLE) AS x,"
    " CAST(embedding[5] AS DOUBLE) AS y, abs(CAST(embedding[6] AS DOUBLE)) * CAST(0.2 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS w,"
    " abs(CAST(embedding[7] AS DOUBLE)) * CAST(0.1 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS h FROM embeddings) q",
    "zones": "SELECT label AS zone, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY label",
    "step_lines": "SELECT l_orderkey, l_extendedprice / 200000 - 0.25::DOUBLE AS ax, l_quantity / 100 - 0.25::DOUBLE AS ay,"
    " l_extendedprice / 200000 - 0.25::DOUBLE + l_discount AS bx, l_quantity / 100 - 0.25::DOUBLE + l_tax AS by_ FROM lineitem",
}


def box_cells(table: str, ids: str) -> str:
    """SQL for the cells of axis-parallel boxes."""
    sep = ", " if ids else ""
    return (
        f"SELECT {ids}{sep}i AS cx, j AS cy FROM (SELECT *, unnest(range(CAST(ceil(x0 / 0.02 - 0.5) AS BIGINT),"
        f" CAST(ceil(x1 / 0.02 - 0.5) AS BIGINT))) AS i FROM {table}) q, LATERAL (SELECT unnest(range("
        "CAST(ceil(y0 / 0.02 - 0.5) AS BIGINT), CAST(ceil(y1 / 0.02 - 0.5) AS BIGINT))) AS j) c"
    )


FIXTURE_SQL["water_cells"] = box_cells("water", "FULLNAME")
FIXTURE_SQL["zone_cells"] = box_cells("zones", "zone")


def with_fixtures(sql: str) -> str:
    """Put the fixtures a statement uses, and those they use, in front of it as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in FIXTURE_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                needed.append(name)

    need(sql)
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in needed)
    sql = sql.strip()
    if not ctes:
        return sql
    if re.match(r"(?i)with\s+recursive\s", sql):
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if re.match(r"(?i)with\s", sql):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
