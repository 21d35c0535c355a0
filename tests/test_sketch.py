"""Planning by a sketch: the same cuts and counts as by the key index, from two scans."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sluicebox import MessageLog, export, plan_export, scratch_dir
from sluicebox.operators import keyindex, sketch
from sluicebox.plans import export as exports
from tests.conftest import series_of, timed


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(keyindex, "MIN_ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(sketch, "RANK_ERROR", 0.004)


def seconds(kind):
    rng = random.Random(7)
    if kind == "even":
        return range(3000)
    if kind == "ties":
        return [rng.randint(0, 700) for _ in range(3000)]
    if kind == "skewed":
        return [rng.expovariate(1) ** 3 for _ in range(3000)]
    return [5.0] * 1200 + [rng.random() * 900 for _ in range(1800)]


def by_index(ds, monkeypatch, **options):
    with monkeypatch.context() as off:
        off.setattr(exports, "cuts_by_sketch", lambda *_: None)
        return plan_export(ds, 4, **options)


@pytest.mark.parametrize("kind", ["even", "ties", "skewed", "a third on one time"])
@pytest.mark.parametrize("options", [{"jobs": 13}, {"jobs": 48, "keep_tail": False}])
def test_cuts_are_those_of_the_key_index(spark, monkeypatch, kind, options):
    ds = series_of(timed(spark, seconds(kind)))
    mine, other = plan_export(ds, 4, **options), by_index(ds, monkeypatch, **options)
    assert mine.ranges == other.ranges
    # A time that is too frequent for a bucket is left to the index.
    assert (mine.chunks is None) == (kind == "a third on one time")
    if mine.chunks:
        counted = mine.index.with_bucket(mine.assigned()).groupBy("partition", "_bucket").count().collect()
        assert sorted((p, b, n) for p, b, n, _ in mine.chunks) == sorted(map(tuple, counted))
        assert mine.index.total == 3000 and all(n == planned for *_, n, planned in mine.chunks)


def test_a_sketch_that_is_off_is_noticed(spark, monkeypatch):
    ds = series_of(timed(spark, seconds("skewed")))
    want = by_index(ds, monkeypatch, jobs=13).ranges
    true = sketch.TimeSketch.quantiles
    monkeypatch.setattr(sketch.TimeSketch, "quantiles", lambda self, df, ranks: true(self, df, [r**2 for r in ranks]))
    plan = plan_export(ds, 4, jobs=13)
    assert plan.chunks is None and plan.ranges == want


@pytest.mark.parametrize("jobs", [4, 48])
def test_offsets_and_rejects_without_a_count(spark, monkeypatch, jobs):
    df = timed(spark, seconds("ties")).withColumn("x", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(1.0))
    logs = [MessageLog(scratch_dir(spark, "sketch"), 4) for _ in range(2)]
    results = [export(series_of(df), logs[0], "t", jobs=jobs)]
    monkeypatch.setattr(exports, "cuts_by_sketch", lambda *_: None)
    results.append(export(series_of(df), logs[1], "t", jobs=jobs))
    first, second = ([tuple(r) for r in x.accounting.collect()] for x in results)
    assert first == second and first[0][-1] and first[0][2] == 429
    one, two = (log.read(spark, "t").select("partition", "offset", F.md5("value")) for log in logs)
    assert one.exceptAll(two).isEmpty() and one.count() == two.count() == 2571


def test_counts_for_other_messages_are_not_used(spark):
    df = timed(spark, range(300)).withColumn("j", F.when(F.col("id") % 3 == 0, "no {").otherwise("1"))
    ds = series_of(df, json_columns=("j",))
    starts = spark.createDataFrame([(p, 0) for p in range(4)], "partition int, offset bigint")
    plan = plan_export(ds, 4, jobs=4)
    assert plan.chunks and not plan.nested
    _, produced = exports.build_messages(plan, starts, nested=True)
    assert produced.agg(F.sum("produced")).first()[0] == 200


def test_few_rows_no_rows_and_many_jobs(spark):
    for n in (0, 1, 5):
        log = MessageLog(scratch_dir(spark, "sketch"), 2)
        assert export(series_of(timed(spark, range(n))), log, "t", jobs=4).accounting.first()["produced"] == n
    assert plan_export(series_of(timed(spark, range(3000))), 4, jobs=1000).chunks is None


def test_an_export_reads_its_source_three_times(spark, tmp_path):
    path = str(tmp_path / "source")
    timed(spark, seconds("ties")).repartition(2).write.parquet(path)
    ds = series_of(spark.read.parquet(path))
    export(ds, MessageLog(scratch_dir(spark, "sketch"), 4), "t", jobs=12)
    store = spark._jsparkSession.sharedState().statusStore()
    store.executionsCount()
    before = store.executionsCount()
    export(ds, MessageLog(scratch_dir(spark, "sketch"), 4), "t", jobs=12)
    time.sleep(1)
    plans = store.executionsList(int(before), 1000)
    texts = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())]
    reads = sum(len(set(re.findall(rf"\((\d+)\) Scan parquet[^(]*?Location: InMemoryFileIndex \[file:{path}\]", t, re.S))) for t in texts)
    assert 1 <= reads <= 3
