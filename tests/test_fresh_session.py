"""The first tables of a fresh session, whose columns have the smallest internal ids."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from datetime import datetime, timedelta
from pyspark.sql import functions as F
from sluicebox import get_session, read_series
from sluicebox.operators.keyindex import KeyIndex, ranked_keys

spark = get_session("fresh", "local[2]", spark__ui__enabled="false")
points = tuple((datetime(2024, 1, 1) + timedelta(hours=h),) for h in range(1, 60))
index = KeyIndex(("ts",), points, (100,) * 60)
for _ in range(4):
    spark.range(1)
ds = read_series(spark, sys.argv[1], database="d", table="t", time="ts", keys=["event_id"])
ranked = ranked_keys(ds.df, index, range(50, 6000, 500)).filter(F.col("rows") > 1).select("ts")
ranked._jdf.queryExecution().optimizedPlan()
print("planned")
"""


def test_bucket_joins_can_be_planned(sf):
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, f"{sf}/events.parquet"],
        cwd=root,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert "planned" in done.stdout, done.stderr[-2000:]
