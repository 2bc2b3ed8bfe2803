"""Times the headline queries; prints one JSON line.

Every query is run once unmeasured (class loading, compilation) and once measured. A run
writes all columns of the result to Spark's no-op sink, so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from questline.queries import QUERIES  # noqa: E402
from questline.session import build_session  # noqa: E402

HEADLINE = [
    "hist_dedupe", "hist_session", "hist_gap", "extract_tables", "extract_parse", "refs_resolve",
    "cat_unique", "cat_tables", "col_lookup", "sim_top3", "sim_pairs", "train_set", "retrieve_topk",
    "retrieve_filter", "answer_prompts", "search_tables", "search_columns", "pre_index", "embed_text",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench", f"local[{cpus}]", spark_ui_enabled="false", spark_sql_shuffle_partitions=cpus,
        spark_driver_memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, second run", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
