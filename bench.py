"""Times the pipeline stages and headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

``stage_*`` entries write the shared stage tables once, in order; the other entries run one query
each on those tables and send the whole result to a sink that drops it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from voltarc.plans.catalog import QUERIES, _held_out  # noqa: E402
from voltarc.plans.pipeline import Pipeline  # noqa: E402

STAGES = ["telemetry", "facts", "placed", "signs", "scored", "tested", "healthy", "ends",
          "cycles", "phases", "phase_features", "missions", "setpoints", "dictionary_phase",
          "dictionary_mission", "horizon"]
HEADLINE = ["cycle_summary", "capacity_tests", "anomalies", "soh_smoothed", "rul_cycles", "soc",
            "segments", "phase_instances", "segment_range_join", "ic_features", "vi_resistance",
            "cv_setpoint", "mission_features", "phase_stress", "mission_table", "dsoh_spearman",
            "mission_degradation", "phase_box_stats", "mission_histograms", "soc_table",
            "soc_sequences", "rul_sequences", "sequence_pooled", "fold_prepare", "isotonic_rul",
            "rul_increase_audit", "attention_summary", "loco_rf", "loco_gbt", "loco_seq", "loco_eval",
            "grid_sweep", "fitted_comparison", "fitted_isotonic"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy().count().collect()  # start the executor threads

    pipeline = Pipeline.from_tables(spark, folder)
    seconds: dict[str, float] = {}
    for name in STAGES:
        start = time.perf_counter()
        getattr(pipeline, name)
        seconds[f"stage_{name}"] = round(time.perf_counter() - start, 3)
    rows = pipeline.telemetry.count()
    failed: dict[str, str] = {}
    inference, samples = None, 0
    for name in HEADLINE:
        start = time.perf_counter()
        try:  # one failing entry does not cost the others
            result = QUERIES[name].spark(pipeline)  # fits the models of a model query
            result.write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:300]}"
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
    if "loco_rf" in seconds:
        inference, samples = _held_out(pipeline, "rf").agg(
            F.avg("predict_ms"), F.count("*")).first()

    total = sum(seconds.values())
    to_phases = sum(seconds[f"stage_{s}"] for s in STAGES[:STAGES.index("phases") + 1])
    print(json.dumps({
        "metric": "pipeline_and_queries_total", "value": round(total, 3), "unit": "sec",
        "queries": seconds, "failed": failed, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus),
        "telemetry_rows": rows, "loco_samples": samples,
        "inference_ms_per_sample": inference and round(inference, 4),
        "rows_per_sec_telemetry_to_phases": round(rows / to_phases, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
