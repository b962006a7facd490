"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from offerlake.plans import QUERIES  # noqa: E402
from offerlake.session import local_session  # noqa: E402

HEADLINE = ["win_topn_capped", "flt_reason", "flt_fresh_post", "sc_local", "win_longest_duplicate", "win_lowest_price_duplicate", "win_detail_lead", "agg_market_median", "agg_cheapest_per_site",
            "agg_lexicon_share", "agg_verdict_rollup", "agg_coverage_report", "agg_token_gain", "jn_item_hits", "jn_full_diff", "jn_asof_last_good_read", "jn_nearest_place", "jn_same_product", "set_shared",
            "tm_occurrences", "srt_local", "snk_snapshot", "stm_activity_sessions"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["flt_min_saving"](spark, sf_dir).collect()                    # warm the JVM
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
