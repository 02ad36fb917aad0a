"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_RUNS the timed
runs per query (the median counts; one more run warms up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from placemetrics.queries.catalogue import QUERIES  # noqa: E402
from placemetrics.session import build_session  # noqa: E402

HEADLINE = [
    "country_years", "top_countries_with_ties", "region_share_index", "country_prodev_summary",
    "home_salary_rank", "province_concentration", "city_table", "world_city_ranks",
    "role_shares", "role_city_quotients", "role_province_export", "language_regions",
    "language_years", "company_sizes_running_share", "industry_comparison", "industry_years",
    "currency_mismatch", "informal_education", "male_female_ratio", "ethnicities",
    "harmonised_respondents", "map_layer_provinces_share", "unpivot_measures",
    "medians_per_group", "rank_with_many_members", "share_with_many_members",
    "keep_first_by_source", "null_safe_two_key_join", "fold_to_ascii",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(f"local[{cpus}]", cpus, "placemetrics-bench",
                          **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(folder).name,
                      "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
