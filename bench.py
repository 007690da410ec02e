"""Time the headline queries; prints one JSON line.

`BENCH_SF_DIR` names the data (default /root/testdata/sf0.1), `BENCH_CPUS` the
local cores. Each query runs once to warm up the session, then `BENCH_ROUNDS`
interleaved rounds; the median counts.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans import load_all  # noqa: E402
from plumbline.session import get_spark  # noqa: E402

HEADLINE = [
    "c4_check_join", "c5_predicted_rows", "c8_match_rate_by_group", "c17_pair_scores", "c24_dedup_report",
    "d4_differential_missingness", "d9_distribution_summary", "d11_numeric_sentinels", "d14_value_spikes", "d17_value_counts",
    "d18_numeric_range", "d20_string_hygiene", "e1_group_aggregates", "e3_quantile_set", "e10_daily_revenue", "f2_lag", "f4_running_sum",
    "f6_entity_profile", "i2_number_tokens", "m1_unique_key", "n2_robust_rungs", "n3_cluster_rungs", "n4_cr2", "n5_wild_cluster_bootstrap",
    "n10_leverage", "n13_within_one_way", "o5_group_time_effects", "p1_error_floor", "q5_krippendorff_alpha", "r1_tell_counts",
    "s1_slice_scan", "s7_numeric_shift", "s9_staleness", "v1_cosine_top_k",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = get_spark(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    times = {q: [] for q in HEADLINE}
    for r in range(rounds + 1):
        for q in HEADLINE if r % 2 else reversed(HEADLINE):
            t0 = time.perf_counter()
            queries[q](spark, folder).write.format("noop").mode("overwrite").save()
            if r:
                times[q].append(time.perf_counter() - t0)
    med = {q: round(statistics.median(t), 3) for q, t in times.items()}
    print(json.dumps({"metric": "total of median seconds over headline queries", "value": round(sum(med.values()), 3), "unit": "sec",
                      "queries": med, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
