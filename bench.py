"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from noticeworks.plans import catalog
from noticeworks.plans.session import local_session, ship

HEADLINE = [
    "price_drops", "chain_fall_median", "median_by_group_min_n", "price_by_tag", "price_per_unit_by_place", "unit_price_histogram", "discount_by_round", "published_by_year_gapfill", "weekly_strip", "lead_days_median",
    "comparables_top3", "dedup_keep_first", "carry_forward_anti", "html_to_text", "money_reconcile", "search_facets", "gates",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first warms up
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(sorted(runs[1:])[1], 4)
    print(json.dumps({"metric": "total seconds of the headline queries, median of 3 after a warm-up", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
