"""Time the layers and the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
``layer_*`` are whole layers from stored table to stored tables, writes included. The other
queries run from the raw tables without intermediate tables. Everything runs once cold and three times
warm; ``queries`` holds the best warm time, ``cold`` the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prosa.checks import QUERIES  # noqa: E402
from prosa.plans.medallion import build_gold, build_silver, ingest  # noqa: E402
from prosa.schemas import SOURCE_MESSAGES  # noqa: E402
from prosa.session import build_session, scratch_dir  # noqa: E402
from prosa.sources.derived import source_messages  # noqa: E402
from prosa.sources.tables import Tables  # noqa: E402

HEADLINE = (
    "bronze_new_rows", "silver_dedup", "silver_entities", "document_entities", "document_masking", "conversations",
    "conversation_extras", "gold_sentiment", "gold_personas", "gold_segmentation", "gold_lead_score", "outcome_funnel",
    "campaign_performance", "seller_metrics", "competitor_outcomes", "quality_profile", "runs_summary",
    "usage_cumulative_cost", "usage_rolling_tokens", "bronze_time_batches",
)
RUNS = 4


def timed(action) -> list[float]:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return times


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    warm, cold = {}, {}

    def record(name: str, times: list[float]) -> None:
        cold[name], warm[name] = round(times[0], 3), round(min(times[1:]), 3)

    root = scratch_dir(spark, "bench")
    source = os.path.join(root, "in.parquet")
    source_messages(spark, d).repartition(int(cpus)).write.parquet(source)
    tables = Tables(spark, root)
    record("layer_bronze", timed(lambda: ingest(tables, source, mode="full", schema=SOURCE_MESSAGES)))
    record("layer_silver", timed(lambda: build_silver(tables)))
    record("layer_gold", timed(lambda: build_gold(tables)))
    for name in HEADLINE:
        record(name, timed(lambda: QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()))
    print(json.dumps({
        "metric": "layers and headline queries, warm run, summed", "value": round(sum(warm.values()), 3),
        "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(d.rstrip("/")), "cpus": int(cpus),
        "messages": tables.count("bronze"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
