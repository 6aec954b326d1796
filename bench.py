"""Time the headline queries and print one JSON line.

Stage queries write the derived tables that later ones read, so every stage is paid for exactly once.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tracewell import catalog
from tracewell.catalog import evaluation_queries
from tracewell.plans import attribution, corpus

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

STAGES = (
    ("plan_parents", corpus.slotted_parents),
    ("plan_recipes", corpus.recipes),
    ("derive_rows", corpus.rows),
    ("search_documents", attribution.scored),
    ("detector_evidence", attribution.detector_evidence),
    ("null_pool", attribution.null_pool),
    ("evaluation_records", evaluation_queries.records),
)
HEADLINE = (
    "f11_character_scores",
    "f2_repetition_ratio",
    "w6_candidate_windows",
    "a32_attribution_documents",
    "j1_assembly_check",
    "w10_empirical_p",
    "w13_batch_packing",
    "j12_token_projection",
    "j13_nearest_fill",
    "w12_sequence_features",
    "a14_stratified_evaluation",
    "a16_oscr",
    "a20_fusion_weight",
    "f8_prototype_distance",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Span search costs far more per byte than a scan, so small splits keep every core busy.
        .config("spark.sql.files.maxPartitionBytes", str(8 << 20))
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.load()[0]
    seconds: dict[str, float] = {}
    for name, build in STAGES:
        start = time.perf_counter()
        build(spark, SF_DIR)
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    searched = attribution.scored(spark, SF_DIR).count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "documents_searched": searched,
                "documents_per_second": round(searched / seconds["search_documents"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
