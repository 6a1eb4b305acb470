"""Times the headline queries and prints one line of JSON: seconds of a warm run of each, and their sum."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["text_primitives", "alias_hits", "skill_match", "term_signals", "hard_eligibility", "role_scores", "tiers", "key_insights", "smart_search", "share_scores", "hiring_history", "vector_similarity", "job_cache", "page_keys"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomrank.plans import catalog

    took: dict[str, float] = {}
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    for name in names:
        query = catalog.QUERIES[name][0]
        runs = []
        for _ in range(2):
            began = time.time()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "seconds of the headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
