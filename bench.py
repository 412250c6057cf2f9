"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkplume.plans import catalog  # noqa: E402
from sparkplume.session import local_session  # noqa: E402

HEADLINE = (
    "flagship",
    "system_stats",
    "system_stats_seasonal",
    "max_by_zip",
    "zip_set_sizes",
    "clip_points",
    "knn",
    "radius_neighbors",
    "idw_variable",
    "idw_fixed",
    "idw_sweep_metrics",
    "zonal_mean",
    "rank_runs",
    "box_stats",
    "kruskal",
    "semivariogram_bins",
    "krige_ordinary",
    "natural_neighbor_grid",
    "ok_sweep_metrics",
    "uk_sweep_metrics",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's machinery before the clock; touches none of the queries
    spark.read.parquet(f"{sf}/region.parquet").groupBy("r_name").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
