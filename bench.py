"""Times the headline queries on one data folder and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from territoria.plans.catalog import REGISTRY
from territoria.session import get_session

HEADLINE = [
    "nation_drought_bands", "site_index", "rolling_windows", "monthly_baseline_z", "dry_spell_metrics", "temporal_percentiles", "station_anomalies",
    "site_score_rank", "feature_screening", "model_error_metrics", "index_level_spearman", "ecdf_index", "loglogistic_drought_index", "nearest_reading",
    "nearest_station", "nearest_neighbours_loo", "radius_neighbours", "point_in_polygon", "bilinear_resample", "withdrawal_density", "idw_sites",
    "idw_parameter_search", "hourly_emission_mix", "plant_dispatch", "zone_pooling", "network_components", "node_pagerank", "hop_statistics",
    "impedance_reach", "graph_filter", "fact_sales", "monthly_revenue", "top_products", "validation_report", "weight_calibration",
    "grid_pipeline_scores", "site_engine",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = get_session("bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
