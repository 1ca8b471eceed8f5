"""Headline timings on one scale factor; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Phases are timed as
they run in practice: each reads the table the phase before it wrote, and each
result is written in full to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from netquarry.config import EngineConfig  # noqa: E402
from netquarry.operators import cleaning, fingerprints  # noqa: E402
from netquarry.plans import contract, fixture, stages  # noqa: E402

HEADLINE = [
    "b10_profile", "c22_normalize", "c23_describe", "d_profile", "e5_silhouette", "e6_davies_bouldin", "e7_nearest_centroid",
    "e13_e14_characterize", "f6_enriched", "g1_cohesion", "g3_overlap", "g5_timing", "g9_confidence", "g10_documents", "h1_drift",
    "i1_i3_families", "j1_nodes", "j2_edges", "j3_degree", "j4_betweenness", "j6_capped_graph", "k1_replay_timeline", "k4_replay_feed",
    "l2_campaign_table", "l6_report_campaigns", "l8_run_summary", "r1_reservoir",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    fixture.table(spark, sf, "nation").count()  # start executors outside the timings
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    timed("phase_ingest", lambda: stages.flows(spark, sf))
    timed("phase_fingerprints", lambda: stages.fingerprint_table(spark, sf))
    timed("phase_campaigns", lambda: stages.campaigns(spark, sf))
    timed("phase_enrich", lambda: stages.enriched(spark, sf))
    timed("phase_hourly", lambda: stages.hourly(spark, sf))
    timed("phase_profile", lambda: stages.profile(spark, sf))
    timed("fingerprints_from_raw_tables", lambda: drain(fingerprints.fingerprints(cleaning.clean(fixture.raw_flows(spark, sf)))))
    sweep = EngineConfig(k_min=2, k_max=10, n_init=10)
    points = contract.standardized(spark, sf)
    timed("clustering_k2_to_10", lambda: drain(contract.clustering.sweep_k(points, sweep)[0]))
    for name in HEADLINE:
        timed(name, lambda: drain(contract.QUERIES[name](spark, sf)))
    print(
        json.dumps(
            {"metric": "flow analysis, phases and report queries", "value": round(sum(times.values()), 3), "unit": "sec",
             "queries": times, "sf": Path(sf).name.removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
