"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

A ``queries`` entry is one run of a registered query, index building included. The methods are then timed as they are
used: against an index that is stored already, for the whole batch of typed queries (``per_query_ms``).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "street_documents", "address_documents_with_popularity", "grouping_sets_aggregate", "place_documents", "query_parse", "postings", "edge_ngrams", "gate_words",
    "suggest_fulltext_exact", "suggest_completion", "latency_summary", "agreement_report", "golden_report", "upsert_merge",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    root = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wayfold.operators.retrieval import REGISTRY
    from wayfold.queries import REGISTERED, index, queries_df

    spark.range(1000).selectExpr("sum(id)").collect()
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.time()
        run(REGISTERED[name](spark, sf_dir))
        times[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    began = time.time()
    stored_index = index(spark, sf_dir).complete()
    times["index_build"] = round(time.time() - began, 3)
    typed = queries_df(spark, sf_dir)
    asked, per_query = typed.count(), {}
    for name, method in REGISTRY.items():
        run(method(typed, stored_index))  # compiled once, as a service is
        began = time.time()
        run(method(typed, stored_index))
        times[f"answer_{name}"] = round(time.time() - began, 3)
        per_query[name] = round(1000 * times[f"answer_{name}"] / asked, 2)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "per_query_ms": per_query, "typed_queries": asked, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
