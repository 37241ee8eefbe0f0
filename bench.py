"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odweave.catalog import QUERIES  # noqa: E402
from odweave.session import drop_stored, get_session  # noqa: E402

HEADLINE = [
    "agg_two_level", "agg_sum", "agg_in", "net_flow", "route_stats", "join_crosswalk_roles", "join_semi_both_ends",
    "filter_no_self", "win_row_number", "win_row_number_group", "win_percent_rank", "win_cum_share", "top_share",
    "agg_median_weighted", "win_add_count", "cumulative_frames", "topk_slice", "topk_ties", "facet_topk", "unpivot_all",
    "endpoint_mean", "role_panel", "complete_grid", "uncount", "graph_node_ids", "graph_layout", "qa_duplicates",
    "geo_centroid", "geo_dissolve", "geo_erase", "geo_overlay", "geo_intersects", "road_flags", "enrich_with_retry",
    "histogram", "density", "tile_matrix", "ml_lm", "ml_cv_metrics", "ml_residual_by_area", "scan_text", "scan_flows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        taken = round(time.perf_counter() - start, 3)
        drop_stored(spark)
        return taken

    run("agg_two_level")  # start the JVM's workers and the code cache
    times = {key: run(key) for key in HEADLINE}
    sf = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
