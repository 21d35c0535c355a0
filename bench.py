"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is
run ``BENCH_RUNS`` times after one warm-up and its best time is kept; every row
of every result is computed. ``row_ordinal_one_task`` is the plain one-partition
window that the distributed numbering has to match.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicebox import get_session
from sluicebox.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "time_range",
    "count_in_range",
    "per_series_profile",
    "dataset_detail",
    "first_last_records",
    "dataset_catalog",
    "row_ordinal",
    "per_series_ordinal",
    "every_nth_boundary",
    "time_split_plan",
    "time_split_plan_ties",
    "time_split_rows",
    "ordinal_split_plan",
    "partition_assignment",
    "ordinal_slice",
    "row_round_robin",
    "batch_records",
    "series_messages",
    "document_messages_without_id",
    "long_text_messages",
    "series_long_form",
    "topic_offsets",
    "export_summary",
    "export_with_ties",
    "query_by_time",
    "collect_estimate",
    "stream_running_counts",
]


def row_ordinal_one_task(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    return df.withColumn("rn", F.row_number().over(W.orderBy("ts", "event_id")))


def timed(query, spark: SparkSession) -> float:
    began = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    conf = {"spark__sql__shuffle__partitions": CPUS, "spark__ui__enabled": "false"}
    spark = get_session("bench", f"local[{CPUS}]", spark__driver__memory="16g", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    queries = {**{name: QUERIES[name] for name in HEADLINE}, "row_ordinal_one_task": row_ordinal_one_task}
    seconds = {}
    for name, query in queries.items():
        timed(query, spark)
        seconds[name] = round(min(timed(query, spark) for _ in range(RUNS)), 4)
    total = sum(v for k, v in seconds.items() if k in HEADLINE)
    line = {
        "metric": "headline_total",
        "value": round(total, 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
