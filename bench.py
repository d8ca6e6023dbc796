"""Benchmark: prints one JSON line with the seconds of every headline query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import REGISTRY  # noqa: E402
from recspark.session import local_session  # noqa: E402

HEADLINE = [
    "product_catalogue",
    "user_history",
    "popularity_topk",
    "embed_products",
    "user_profile_mean",
    "exact_topk",
    "ivf_topk",
    "recommend_history",
    "recommend_blend",
    "zero_shot_topk",
    "rerank_fill",
    "eco_score",
    "search_criteria",
    "cf_recommend",
    "compare_baselines",
    "ndcg_at_k",
    "stream_product_stats",
]
# What one row of the per-second figure stands for.
REQUESTS = {"exact_topk": "query_id", "ivf_topk": "query_id", "recommend_history": "query_id", "zero_shot_topk": "query_id"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # A query that is no headline of requests per second starts the JVM's and the workers' machinery, so that no query pays for it.
    REGISTRY["popularity_topk"](spark, sf_dir).count()
    seconds, per_second = {}, {}
    for name in names:
        start = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    for name, key in REQUESTS.items():
        if name in seconds:
            asked = REGISTRY[name](spark, sf_dir).select(key).distinct().count()
            per_second[name] = round(asked / seconds[name], 1)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "requests_per_second": per_second,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": os.environ.get("BENCH_CPUS", "8"),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
