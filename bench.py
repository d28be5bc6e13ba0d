"""Time the headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cellweave.plans import all_queries
from cellweave.session import get_session

HEADLINE = [
    "assign_region", "geodesic_area", "overlap_ratios", "radius_pairs", "semi_active", "anti_free", "active_cells", "geohash_encode", "tile_xy",
    "pixel_heat", "cells_difference", "release_full_outer", "change_log", "novelty", "covered_drop", "selection", "norm_text", "order_identity",
    "settlement", "eval_metrics", "auc", "label_rules", "training_text", "mlp",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": os.environ.get("BENCH_PARTITIONS", str(2 * int(cpus)) if cpus.isdigit() else "16"),
        "spark.cellweave.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).count()
    queries, times = all_queries(), {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
