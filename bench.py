"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads.  Every
query is run to its last row and column by a sink that discards them.
"""

from __future__ import annotations

import json
import os
import time

from colonnade.plans.registry import Tables, load_all
from colonnade.session import build_session

HEADLINE = (
    "q_segment_dp", "q_backtrace", "q_segment_unary", "q_data_cost", "q_model_prefix", "q_strip_median",
    "q_hough_votes", "q_line_geometry", "q_rect_join", "q_majority_assign", "q_segment_best_class",
    "q_dbscan_core_only", "q_dbscan_masked", "q_nearest_core", "q_eps_neighbors", "q_instance_median_avg",
    "q_offset_loss", "q_instance_ap", "q_iou", "q_asof_config", "q_sync4_batch", "q_multiway_key_join",
    "q_segment_text_parse", "q_quads_3d", "q_rasterize", "q_frame_pipeline",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    every = load_all()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    Tables(spark, sf_dir).lineitem.agg({"l_quantity": "sum"}).collect()  # start the executors
    spark.range(1000).repartition(int(cpus)).mapInArrow(lambda batches: batches, "id long").count()  # and their Python workers
    took = {}
    for name in names:
        t0 = time.perf_counter()
        every[name].run(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
