from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from sluicebox import MessageLog, export, high_watermarks, scratch_dir
from sluicebox.operators.offsets import messages_per_partition, offsets_frame
from sluicebox.streaming import readers
from tests.conftest import series_of, timed


@pytest.fixture
def log(spark):
    log = MessageLog(scratch_dir(spark, "stream"), 3)
    export(series_of(timed(spark, range(90))), log, "t", jobs=6)
    return log


def test_running_counts_equal_the_batch_counts(spark, log):
    counts = readers.running_counts(log.read_stream(spark, "t"))
    got = readers.drain_counts(counts, f"{log.root}-s", f"{log.root}-c")
    assert dict(got.collect()) == dict(messages_per_partition(log.read(spark, "t")).collect())


def test_counts_go_on_after_a_restart(spark, log):
    path, checkpoint = f"{log.root}-s", f"{log.root}-c"
    first = readers.drain_counts(readers.running_counts(log.read_stream(spark, "t")), path, checkpoint)
    assert sum(r["messages"] for r in first.collect()) == 90
    export(series_of(timed(spark, range(30))), log, "t", jobs=6)
    second = readers.drain_counts(readers.running_counts(log.read_stream(spark, "t")), path, checkpoint)
    assert sum(r["messages"] for r in second.collect()) == 120


def test_start_at_the_end(spark, log):
    ends = dict(high_watermarks(log.read(spark, "t"), 3).collect())
    export(series_of(timed(spark, range(12))), log, "t", jobs=6)
    stream = readers.from_offsets(log.read_stream(spark, "t"), offsets_frame(spark, ends))
    got = readers.drain_to_table(stream, f"{log.root}-o", f"{log.root}-c")
    assert got.count() == 12
    assert all(r["offset"] >= ends[r["partition"]] for r in got.select("partition", "offset").collect())


def test_second_drain_adds_only_new_messages(spark, log):
    out, checkpoint = f"{log.root}-o", f"{log.root}-c"
    assert readers.drain_to_table(log.read_stream(spark, "t"), out, checkpoint).count() == 90
    assert readers.drain_to_table(log.read_stream(spark, "t"), out, checkpoint).count() == 90
    export(series_of(timed(spark, range(10))), log, "t", jobs=6)
    drained = readers.drain_to_table(log.read_stream(spark, "t"), out, checkpoint)
    keys = drained.select("partition", "offset", F.md5("value"))
    assert keys.count() == 100 and keys.exceptAll(log.read(spark, "t").select("partition", "offset", F.md5("value"))).isEmpty()


def test_bounded_collect(spark, log):
    start, end = offsets_frame(spark, {0: 3, 1: 0, 2: 5}), offsets_frame(spark, {0: 10, 1: 1, 2: 5})
    stream = readers.up_to_offsets(log.read_stream(spark, "t"), start, end)
    got = readers.drain_to_table(stream, f"{log.root}-o", f"{log.root}-c")
    assert sorted((r["partition"], r["offset"]) for r in got.collect()) == [(0, o) for o in range(3, 10)] + [(1, 0)]


def test_watching_counts(spark, log):
    query = readers.watch_counts(log.read_stream(spark, "t"), "seen", f"{log.root}-c", "200 milliseconds")
    try:
        for _ in range(100):
            if spark.table("seen").agg(F.sum("messages")).first()[0] == 90:
                break
            time.sleep(0.2)
        assert sum(r["messages"] for r in spark.table("seen").collect()) == 90
    finally:
        query.stop()


def test_a_reader_may_be_there_before_the_first_message(spark):
    log = MessageLog(scratch_dir(spark, "stream"), 3)
    stream = log.read_stream(spark, "t")
    assert readers.drain_to_table(stream, f"{log.root}-o", f"{log.root}-c").count() == 0
    export(series_of(timed(spark, range(25))), log, "t", jobs=6)
    assert readers.drain_to_table(stream, f"{log.root}-o", f"{log.root}-c").count() == 25
