"""Row ids, ranks, running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.operators import windows as w
from odweave.operators.aggregates import add_share

_ORDER = "ORDER BY commuters DESC, h_geocode, w_geocode"


@query("win_row_number", f"SELECT *, row_number() OVER ({_ORDER}) AS id FROM flows_pair")
def win_row_number(t: Tables) -> DataFrame:
    return w.add_row_id(t.flows_pair, ["-commuters", "h_geocode", "w_geocode"])


_STEP_ORDER = "PARTITION BY h_tract, w_tract ORDER BY l_linenumber, l_partkey, l_suppkey, distance"
_STEPS = (
    "SELECT h_tract, w_tract, l_linenumber, l_partkey, l_suppkey, CAST(distance AS DOUBLE) AS distance,"
    f" row_number() OVER ({_STEP_ORDER}) AS id FROM steps"
)
_STEP_COLS = ["h_tract", "w_tract", "l_linenumber", "l_partkey", "l_suppkey", "distance"]


def _step_ids(t: Tables) -> DataFrame:
    out = w.add_step_id(t.steps.select(*_STEP_COLS), ["h_tract", "w_tract"], _STEP_COLS[2:])
    return out.withColumn("distance", F.col("distance").cast("double"))


@query("win_row_number_group", _STEPS)
def win_row_number_group(t: Tables) -> DataFrame:
    return _step_ids(t)


@query("win_percent_rank", "SELECT *, percent_rank() OVER (ORDER BY commuters) AS percentile FROM flows_pair")
def win_percent_rank(t: Tables) -> DataFrame:
    return w.add_percent_rank(t.flows_pair, "commuters")


_CUM = (
    f"SELECT h_geocode, w_geocode, commuters, row_number() OVER ({_ORDER}) AS id,"
    " commuters / (SELECT sum(commuters) FROM flows_pair) AS pct_commuters,"
    f" CAST(sum(commuters) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS DOUBLE) / (SELECT sum(commuters) FROM flows_pair)"
    " AS cumulative_pct_commuters FROM flows_pair"
)


@query("win_cum_share", _CUM)
def win_cum_share(t: Tables) -> DataFrame:
    return w.cumulative_share(t.flows_pair, "commuters", ["h_geocode", "w_geocode"])


@query("top_share", f"SELECT h_geocode, w_geocode, commuters FROM ({_CUM}) q WHERE cumulative_pct_commuters <= 0.1")
def top_share(t: Tables) -> DataFrame:
    return w.top_share(t.flows_pair, "commuters", 0.1, ["h_geocode", "w_geocode"])


@query("win_add_count", "SELECT h_tract, w_tract, duration, count(*) OVER (PARTITION BY h_tract, w_tract) AS n FROM trips")
def win_add_count(t: Tables) -> DataFrame:
    return w.add_count(t.trips.drop("commuters"), ["h_tract", "w_tract"], sort=True)


@query("win_share_whole", "SELECT *, commuters / (SELECT sum(commuters) FROM flows_pair) AS pct_commuters FROM flows_pair")
def win_share_whole(t: Tables) -> DataFrame:
    return add_share(t.flows_pair, "commuters")


@query(
    "cumulative_frames",
    "SELECT id, CAST(sum(sum(dur)) OVER (ORDER BY id) AS BIGINT) AS cumulative_duration,"
    " CAST(sum(count(*)) OVER (ORDER BY id) AS BIGINT) AS cumulative_rows"
    f" FROM (SELECT duration AS dur, row_number() OVER ({_STEP_ORDER}) AS id FROM steps) q GROUP BY id",
)
def cumulative_frames(t: Tables) -> DataFrame:
    ids = w.add_step_id(t.steps.select(*_STEP_COLS, "duration"), ["h_tract", "w_tract"], _STEP_COLS[2:])
    return w.cumulative_frames(ids, "id", ["duration"])


@query(
    "cumulative_frames_real",
    "SELECT id, round(sum(sum(hours)) OVER (ORDER BY id), 6) AS cumulative_hours, CAST(sum(sum(km)) OVER (ORDER BY id) AS DOUBLE) AS cumulative_km,"
    " CAST(sum(count(*)) OVER (ORDER BY id) AS BIGINT) AS cumulative_rows"
    f" FROM (SELECT duration / CAST(60 AS DOUBLE) AS hours, distance AS km, row_number() OVER ({_STEP_ORDER}) AS id FROM steps) q GROUP BY id",
)
def cumulative_frames_real(t: Tables) -> DataFrame:
    steps = t.steps.select(*_STEP_COLS, (F.col("duration") / F.lit(60.0)).alias("hours"), F.col("distance").cast("double").alias("km"))
    frames = w.cumulative_frames(w.add_step_id(steps, ["h_tract", "w_tract"], _STEP_COLS[2:]), "id", ["hours", "km"])
    return frames.withColumns({"cumulative_hours": F.round("cumulative_hours", 6), "cumulative_km": F.round("cumulative_km", 2)})


_FAR = "ORDER BY distance DESC, w_tract"
_FAR_SHARE = f"round(sum(distance) OVER ({_FAR} ROWS UNBOUNDED PRECEDING) / (SELECT sum(distance) FROM routes), 9)"


@query(
    "win_cum_share_real",
    f"SELECT h_tract, w_tract, distance, row_number() OVER ({_FAR}) AS id, round(distance / (SELECT sum(distance) FROM routes), 9) AS pct_distance,"
    f" {_FAR_SHARE} AS cumulative_pct_distance FROM routes",
)
def win_cum_share_real(t: Tables) -> DataFrame:
    routes = t.routes.select("h_tract", "w_tract", F.col("distance").cast("double").alias("distance"))
    ranked = w.cumulative_share(routes, "distance", ["w_tract"])
    return ranked.withColumns({c: F.round(c, 9) for c in ("pct_distance", "cumulative_pct_distance")})
