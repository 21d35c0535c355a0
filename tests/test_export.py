from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sluicebox import Dataset, MessageLog, export, plan_export, query_by_time, scratch_dir
from sluicebox.operators import keyindex
from sluicebox.operators.messages import series_messages
from sluicebox.plans.export import build_messages
from sluicebox.operators.offsets import offsets_frame
from sluicebox.sources.dataset import read_series
from sluicebox.sources.log import offsets_json
from tests.conftest import at, plan_text, series_of, timed


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(keyindex, "MIN_ROWS_PER_BUCKET", 20)


@pytest.fixture
def log(spark):
    return MessageLog(scratch_dir(spark, "test"), 4)


def read(spark, log, topic="t"):
    rows = log.read(spark, topic).select("partition", "offset", F.col("value").cast("string").alias("v"))
    return [(r["partition"], r["offset"], json.loads(r["v"])) for r in rows.orderBy("partition", "offset").collect()]


def assert_dense(rows, starts=None):
    for p in {p for p, _, _ in rows}:
        offsets = [o for q, o, _ in rows if q == p]
        first = (starts or {}).get(p, 0)
        assert offsets == list(range(first, first + len(offsets)))


def test_every_row_once_dense_and_in_order(spark, log):
    rng = random.Random(1)
    seconds = [0, *(rng.randrange(90) for _ in range(499))]
    result = export(series_of(timed(spark, seconds)), log, "t", jobs=12)
    rows = read(spark, log)
    assert sorted(v["id"] for _, _, v in rows) == list(range(500))
    assert_dense(rows)
    for p in range(4):
        mine = [(v["_time"], v["id"]) for q, _, v in rows if q == p]
        assert mine == sorted(mine)
    assert set(rows[0][2]) == {"_measurement", "_time", "id"} and rows[0][2]["_measurement"] == "t"
    assert all(r["matches"] for r in result.audit.collect())
    summary = result.summary.first()
    assert summary["total_messages"] == 500 and summary["end_time_millis"] >= summary["start_time_millis"]
    assert summary["query_start_str"] == "2024-01-01T00:00:00.000Z"


def test_second_run_goes_on_where_the_first_ended(spark, log):
    ds = series_of(timed(spark, range(100)))
    first = export(ds, log, "t", jobs=8).summary.first()["offsets_data"]
    second = export(ds, log, "t", jobs=8)
    assert_dense(read(spark, log))
    firsts = [line.split(":") for line in first]
    seconds = [line.split(":") for line in second.summary.first()["offsets_data"]]
    assert [int(a[2]) + 1 for a in firsts] == [int(b[1]) for b in seconds]


def test_topics_are_apart(spark, log):
    ds = series_of(timed(spark, range(10)))
    export(ds, log, "one", jobs=4)
    assert log.read(spark, "two").count() == 0
    export(ds, log, "two", jobs=4)
    assert log.read(spark, "one").count() == log.read(spark, "two").count() == 10


def test_run_folder_is_never_overwritten(spark, log):
    ds = series_of(timed(spark, range(10)))
    plan = plan_export(ds, 4, jobs=4)
    sent, _ = build_messages(plan, offsets_frame(spark, dict.fromkeys(range(4), 0)))
    log.write(sent, "t", "run-x")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        log.write(sent, "t", "run-x")


def test_collection_hides_its_id_and_keeps_nulls(spark, log):
    rows = [(f"id{i:03d}", i, None if i % 2 else "x", "own") for i in range(50)]
    df = spark.createDataFrame(rows, "_id string, n int, v string, _source string")
    ds = Dataset(df, "db", "coll", "collection", None, ("_id",), ("_id",))
    result = export(ds, log, "t", jobs=8)
    got = read(spark, log)
    assert_dense(got)
    assert sorted(v["n"] for _, _, v in got) == list(range(50))
    assert all(
        v == {"n": v["n"], "v": None if v["n"] % 2 else "x", "_source": "mongodb", "_collection": "coll", "_database": "db"}
        for _, _, v in got
    )
    assert result.summary.first()["query_start_str"] == ""


def test_range_of_a_collection_only_on_query_by_time(spark, log):
    ds = series_of(timed(spark, range(30)), kind="collection")
    assert export(ds, log, "a", jobs=4).summary.first()["query_end_str"] == ""
    summary = query_by_time(ds, log, "b", window=(at(5), at(25)), jobs=4).summary.first()
    assert (summary["query_start_str"], summary["query_end_str"]) == (
        "2024-01-01T00:00:05.000Z",
        "2024-01-01T00:00:24.000Z",
    )
    assert summary["total_messages"] == 20


def test_rejected_rows_are_left_out_and_offsets_stay_dense(spark, log):
    df = timed(spark, range(60)).withColumn("x", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(1.5))
    for strategy, topic in (("job", "a"), ("row", "b")):
        result = export(series_of(df), log, topic, jobs=8, strategy=strategy)
        got = read(spark, log, topic)
        assert_dense(got)
        assert sorted(v["id"] for _, _, v in got) == [i for i in range(60) if i % 7]
        assert all(r["matches"] for r in result.audit.collect())


def test_rows_dealt_out_in_turn(spark, log):
    export(series_of(timed(spark, range(50))), log, "t", jobs=8, strategy="row")
    assert [(p, o, v["id"]) for p, o, v in read(spark, log)] == sorted((i % 4, i // 4, i) for i in range(50))


def test_empty_dataset(spark, log):
    result = export(series_of(timed(spark, [])), log, "t")
    summary = result.summary.first()
    assert summary["total_messages"] == 0
    assert summary["offsets_data"] == ["0:0:-1", "1:0:-1", "2:0:-1", "3:0:-1"]
    assert log.read(spark, "t").count() == 0


def test_tail_can_be_left_out(spark, log):
    ds = series_of(timed(spark, range(103)))
    kept = export(ds, log, "a", jobs=10, drop_last=False, keep_tail=True).summary.first()["total_messages"]
    cut = export(ds, log, "b", jobs=10, drop_last=False, keep_tail=False).summary.first()["total_messages"]
    per_job = 103 // 8
    assert kept == 103 and cut == 103 // per_job * per_job


def test_reserved_names(spark, log):
    ds = series_of(timed(spark, [1]).withColumn("partition", F.lit(1)))
    with pytest.raises(ValueError, match="rename"):
        export(ds, log, "t")
    with pytest.raises(ValueError, match="strategy"):
        build_messages(plan_export(series_of(timed(spark, [1])), 4), offsets_frame(spark, {}), strategy="any")


def test_copies_of_one_row_are_spread_and_numbered(spark, log, tmp_path):
    """Two thirds of the rows are identical in every column."""
    path = str(tmp_path / "copies")
    at_one = F.lit("2024-01-01 00:00:01").cast("timestamp_ntz")
    df = spark.range(600).select(
        F.when(F.col("id") < 400, at_one).otherwise(F.timestamp_add("SECOND", F.col("id"), at_one)).alias("ts"),
        F.when(F.col("id") < 400, F.lit(-1)).otherwise(F.col("id")).alias("v"),
    )
    df.repartition(3).write.parquet(path)
    ds = read_series(spark, path, database="d", table="t", time="ts")
    plan = plan_export(ds, 4, jobs=8)
    assert max(plan.index.counts) < 400
    export(ds, log, "t", jobs=8)
    rows = read(spark, log)
    assert_dense(rows)
    assert sorted(v["v"] for _, _, v in rows) == [-1] * 400 + list(range(400, 600))
    assert set(rows[0][2]) == {"_measurement", "_time", "v"}


def test_nested_json_text(spark):
    df = timed(spark, [1]).withColumn("props", F.lit('{"b": [1, {"a": null}], "a": "<"}'))
    ds = series_of(df, json_columns=("props",))
    plain, nested = (json.loads(series_messages(ds, nested=n).first()["value"]) for n in (False, True))
    assert plain["props"] == '{"b": [1, {"a": null}], "a": "<"}'
    assert nested["props"] == {"a": "<", "b": [1, {"a": None}]}


def test_one_shuffle_of_rows(spark, sf):
    ds = read_series(spark, f"{sf}/events.parquet", database="d", table="events", time="ts", keys=["event_id"])
    plan = plan_export(ds, 4)
    sent, _ = build_messages(plan, offsets_frame(spark, dict.fromkeys(range(4), 0)))
    text = plan_text(sent)
    assert text.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in text and "Python" not in text and "CartesianProduct" not in text


def test_counting_offsets_reads_keys_only(spark, sf):
    ds = read_series(spark, f"{sf}/events.parquet", database="d", table="events", time="ts", keys=["event_id"])
    plan = plan_export(ds, 4)
    placed = plan.index.with_bucket(plan.assigned()).groupBy("partition", keyindex.BUCKET).count()
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan_text(placed)


def test_offsets_json():
    assert offsets_json("t", {1: 5, 0: 2}) == '{"t": {"0": 2, "1": 5}}'
