"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridrisk.catalog import QUERIES  # noqa: E402
from gridrisk.session import build_session  # noqa: E402

HEADLINE = [
    "rank_communities",
    "enriched_parcels",
    "community_agg_zip",
    "latest_avm",
    "vendor_priors",
    "global_priors",
    "merge_kev",
    "scan_cve_json",
    "device_score",
    "fleet_by_country",
    "community_scores",
    "state_summary",
    "describe_features",
    "corr_matrix",
    "join_nearby_devices",
    "alert_top_n",
    "norm_text",
    "is_relevant_text",
    "identify_vendor",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "gridrisk-bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's readers and code generator before the clock does.
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
