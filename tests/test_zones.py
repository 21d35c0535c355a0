"""Zoned times give the same answers wherever the Python process thinks it is."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sluicebox import Dataset
from sluicebox.functions.times import time_literal
from tests.conftest import plan_text

PROBE = """
import json, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from sluicebox import Dataset, get_session, ordinal_slice, time_split_plan, dataset_detail
spark = get_session("zones", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
spark.sparkContext.setLogLevel("OFF")
df = spark.range(4000).select(F.col("id"), F.timestamp_seconds(F.col("id") + 1704067200).alias("ts"))
ds = Dataset(df, "db", "t", "series", "ts", ("id",))
part = ordinal_slice(df, ["ts", "id"], 800, 3200).agg(F.count("*"), F.min("id"), F.max("id")).first()
plan = [str(r["start_ts"]) + str(r["end_ts"]) for r in time_split_plan(df, "ts", 4, 2, "x").orderBy("job_id").collect()]
detail = dataset_detail(ds).first()
print("ANSWER" + json.dumps([list(part), plan, detail["start"], detail["end"], detail["data"]]))
"""


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_same_answers_in_another_zone(zone):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run(
        [sys.executable, "-c", PROBE.format(repo=repo)], env=os.environ | {"TZ": zone}, capture_output=True, text=True
    )
    got = json.loads(said.stdout.rpartition("ANSWER")[2])
    assert got[0] == [2400, 800, 3199]
    assert got[1][0].startswith("2024-01-01 00:00:00")
    assert got[2] == "2024-01-01T00:00:00Z" and got[3] == "2024-01-01T01:06:39Z"
    assert len(got[4]) == 2


def test_offset_of_a_bound_counts(spark):
    east = timezone(timedelta(hours=2))
    row = spark.range(1).select(
        time_literal("2024-01-05T06:00:00+02:00").alias("a"),
        time_literal("2024-01-05T04:00:00Z").alias("b"),
        time_literal(datetime(2024, 1, 5, 6, tzinfo=east)).alias("c"),
        time_literal(datetime(2024, 1, 5, 4, tzinfo=UTC)).alias("d"),
    ).first()
    assert set(row) == {datetime(2024, 1, 5, 4)}


def test_window_on_a_zoned_column_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.timestamp_seconds(F.col("id") + 1704067200).alias("ts")).write.parquet(path)
    ds = Dataset(spark.read.parquet(path), "db", "t", "series", "ts", ("id",))
    rows = ds.selected(window=("2024-01-01T00:00:02Z", "2024-01-01T00:00:05Z"))
    assert sorted(r["id"] for r in rows.collect()) == [2, 3, 4]
    pushed = plan_text(rows).partition("PushedFilters")[2][:400]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
