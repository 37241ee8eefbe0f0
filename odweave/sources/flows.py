"""Flow files by state, part, job type and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from odweave.functions.semantics import strict_sum, try_num
from odweave.functions.text import area_prefix
from odweave.sources.flow_source import FlowSource

# fixed values: length of an area code at each level of a 15-digit block code
CODE_LENGTH = {"state": 2, "county": 5, "tract": 11, "bg": 12, "block": 15}


def flow_file(state: str, part: str, job_type: str, year: int) -> str:
    """Public naming of a state's origin-destination file."""
    return f"{state.lower()}_od_{part}_{job_type}_{year}.csv"


def read_flows(
    spark: SparkSession,
    root: str,
    states: Sequence[str],
    year: int | Sequence[int],
    parts: Sequence[str] = ("main",),
    job_type: str = "JT00",
    segment: str = "S000",
    agg_geo: str = "block",
    partitions: int | None = None,
) -> DataFrame:
    """Rows ``state, w_<geo>, h_<geo>, <segment>, year, part`` of the chosen files, summed per pair of areas.

    Only the chosen files are opened, each by the task that reads it; state, part and year come from the file name. Columns are
    taken by name, whatever their order in a file; a file without a code column or without the segment is an error, and so is
    a state, part and year without a file. The prefix is taken before the sum, so that the partial sums shrink the shuffle.
    """
    years = [year] if isinstance(year, int) else list(year)
    spark.dataSource.register(FlowSource)
    chosen = {"state": [s.lower() for s in states], "part": parts, "year": years}
    raw = spark.read.format(FlowSource.name()).option("segment", segment).option("jobtype", job_type)
    for name, values in chosen.items():
        raw = raw.option(name, ",".join(map(str, values)))
    n = CODE_LENGTH[agg_geo]
    flows = raw.load(root).select(
        "state", area_prefix("w_geocode", n).alias(f"w_{agg_geo}"), area_prefix("h_geocode", n).alias(f"h_{agg_geo}"),
        try_num("count", "bigint").alias(segment), "year", "part",
    )
    if partitions:
        flows = flows.repartition(partitions)
    if agg_geo == "block":
        return flows
    keys = ["state", f"w_{agg_geo}", f"h_{agg_geo}", "year", "part"]
    return flows.groupBy(*keys).agg(strict_sum(segment).alias(segment)).select(
        "state", f"w_{agg_geo}", f"h_{agg_geo}", segment, "year", "part"
    )
