from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebox.operators import keyindex, split
from sluicebox.operators.filters import in_window, tagged, without_names
from sluicebox.sources.dataset import read_series
from tests.conftest import at, plan_text, series_of, timed


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(keyindex, "MIN_ROWS_PER_BUCKET", 5)


def jobs_by_hand(seconds, jobs):
    """Job of each row by searching the cuts one after the other."""
    ordered = sorted(seconds)
    per_job = max(1, len(ordered) // jobs)
    cuts = [ordered[k * per_job - 1] for k in range(1, len(ordered) // per_job + 1)]
    return cuts, {s: next((k for k, c in enumerate(cuts) if s <= c), len(cuts)) for s in ordered}


def check_time_split(spark, seconds, jobs):
    df = timed(spark, seconds)
    plan = split.plan_by_time(df, "ts", jobs)
    cuts, expected = jobs_by_hand(seconds, jobs)
    assert list(plan.cuts) == [at(c) for c in cuts]
    placed = plan.assign(df).collect()
    assert len(placed) == len(seconds)
    assert all(r["job_id"] == expected[seconds[r["id"]]] for r in placed)
    kept = split.plan_by_time(df, "ts", jobs, keep_tail=False)
    assert kept.assign(df).count() == sum(1 for s in seconds if cuts and s <= cuts[-1])
    return plan


@pytest.mark.parametrize(
    "seconds, jobs",
    [
        (list(range(100)), 7),
        ([5] * 50, 4),
        ([1] * 30 + [2] * 30, 8),
        ([1, 2, 3, 3, 3, 3, 4, 5, 6, 7], 5),
        ([1], 48),
        ([1, 2, 3, 4, 5], 48),
        ([0.000001 * i for i in range(200)], 9),
        ([7] * 200 + list(range(400)), 12),
    ],
)
def test_time_split(spark, seconds, jobs):
    check_time_split(spark, random.Random(0).sample(seconds, len(seconds)), jobs)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 25), min_size=1, max_size=80), st.integers(1, 12))
def test_time_split_any(spark, seconds, jobs):
    check_time_split(spark, seconds, jobs)


def test_tie_at_a_cut_leaves_a_numbered_empty_job(spark):
    df = timed(spark, [1, 2, 2, 2, 2, 2, 3, 4])
    plan = split.plan_by_time(df, "ts", 4)
    assert plan.cuts == (at(2), at(2), at(2), at(4))
    counts = dict(plan.assign(df).groupBy("job_id").count().collect())
    assert counts == {0: 6, 3: 2}
    ranges = plan.to_df(spark, 2, "t").orderBy("job_id").collect()
    assert [tuple(r) for r in ranges] == [
        (0, at(1), at(2), 0, "t"),
        (1, at(2), at(2), 1, "t"),
        (2, at(2), at(2), 0, "t"),
        (3, at(2), at(4), 1, "t"),
    ]


def test_no_rows_no_jobs(spark):
    plan = split.plan_by_time(timed(spark, []), "ts", 48)
    assert plan.ranges() == [] and plan.rows == 0
    assert plan.to_df(spark, 4, "t").count() == 0
    assert plan.assign(timed(spark, [])).count() == 0


def test_rows_without_a_time_are_in_no_range(spark):
    df = spark.createDataFrame([(1, at(1)), (2, None), (3, at(3))], "id int, ts timestamp_ntz")
    plan = split.plan_by_time(df, "ts", 2)
    assert sorted(r["id"] for r in plan.assign(df).collect()) == [1, 3]


def test_half_open_total_leaves_out_the_last_record(spark):
    df = timed(spark, range(100))
    assert split.plan_by_time(df, "ts", 9).rows_per_job == 11
    assert split.plan_by_time(df, "ts", 100, total_mode="half_open").rows_per_job == 1
    assert split.plan_by_time(df, "ts", 10, total_mode="half_open").rows_per_job == 9
    with pytest.raises(ValueError):
        split.plan_by_time(df, "ts", 10, total_mode="some")


def test_index_on_more_keys_gives_the_same_cuts(spark):
    rng = random.Random(4)
    df = timed(spark, [rng.randrange(40) for _ in range(300)])
    index = keyindex.build_index(df, ["ts", "id"])
    assert split.plan_by_time(df, "ts", 13, index=index) == split.plan_by_time(df, "ts", 13)


@pytest.mark.parametrize("rows, jobs", [(0, 4), (1, 48), (5, 48), (100, 7), (100, 48), (96, 48), (300, 1)])
def test_ordinal_split(spark, rows, jobs):
    keys = random.Random(rows).sample(range(5000), rows)
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    plan = split.plan_by_ordinal(df, ["k"], jobs)
    ranges = [tuple(r)[:3] for r in plan.to_df(spark, 4, "t").orderBy("job_id").collect()]
    assert ranges[0][1] == 0 and ranges[-1][2] == rows and len(ranges) == jobs
    sizes = [b - a for _, a, b in ranges]
    assert max(sizes) - min(sizes) <= 1
    placed = {r["k"]: r["job_id"] for r in plan.assign(df).collect()}
    expected = [j for j, n in enumerate(sizes) for _ in range(n)]
    assert [placed[k] for k in sorted(keys)] == expected


def test_ordinal_split_of_text_ids(spark):
    ids = [f"{random.Random(i).getrandbits(96):024x}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "_id string")
    plan = split.plan_by_ordinal(df, ["_id"], 16)
    counts = dict(plan.assign(df).groupBy("job_id").count().collect())
    assert counts == {j: 13 if j < 8 else 12 for j in range(16)}


def test_wrong_numbers(spark):
    df = timed(spark, [1, 2])
    for call in (
        lambda: split.plan_by_time(df, "ts", 0),
        lambda: split.plan_by_ordinal(df, ["id"], 0),
        lambda: split.ordinal_split_plan(df, 0, 4, "t"),
        lambda: split.ordinal_split_plan(df, 4, 0, "t"),
        lambda: split.assign_jobs(df, split.plan_by_time(df, "ts", 2), 0),
        lambda: split.round_robin(df, ["id"], 0),
    ):
        with pytest.raises(ValueError):
            call()


def test_jobs_go_to_partitions_in_turn(spark):
    df = timed(spark, range(60))
    placed = split.assign_jobs(df, split.plan_by_time(df, "ts", 6), 4)
    assert sorted(set((r["job_id"], r["partition"]) for r in placed.collect())) == [
        (0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 1),
    ]


def test_windows_and_tags(spark):
    df = timed(spark, range(10)).withColumn("tag", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(in_window(df, "ts", at(2), at(5))) == [2, 3, 4]
    assert ids(in_window(df, "ts", "2024-01-01T00:00:08Z", None)) == [8, 9]
    assert ids(in_window(df, "ts", None, at(1))) == [0]
    assert ids(tagged(df, ("tag", "even"))) == [0, 2, 4, 6, 8]
    assert ids(tagged(df, ("tag", ""))) == ids(tagged(df, ("", "even"))) == ids(tagged(df, None)) == list(range(10))
    assert ids(tagged(df, ("id", "3"))) == ids(tagged(df, ("id", 3))) == [3]
    assert ids(tagged(df, ("id", "03"))) == [] and ids(tagged(df, ("id", "03"), as_text=False)) == [3]
    assert ids(tagged(df, ("id", "x"))) == ids(tagged(df, ("id", "x"), as_text=False)) == []
    assert ids(without_names(df, "tag", ["odd", "none"])) == [0, 2, 4, 6, 8]


def test_filters_reach_the_scan(spark, sf):
    ds = read_series(spark, f"{sf}/events.parquet", database="d", table="events", time="ts", keys=["event_id"])
    rows = ds.selected(tag=("user_id", "17"), window=("2024-01-05", "2024-01-06")).select("event_id")
    plan = plan_text(rows)
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "EqualTo(user_id,17)" in pushed
    assert "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_slice_reads_only_its_key_range(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    index = keyindex.build_index(df, ["o_orderkey"], buckets=20)
    plan = plan_text(split.ordinal_slice(df, ["o_orderkey"], 500, 600, index=index))
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(o_orderkey" in pushed and "LessThanOrEqual(o_orderkey" in pushed


def test_assigning_jobs_needs_no_shuffle(spark):
    df = timed(spark, range(300))
    by_time = split.assign_jobs(df, split.plan_by_time(df, "ts", 48), 4)
    by_id = split.assign_jobs(df, split.plan_by_ordinal(df, ["id"], 48), 4)
    assert "Exchange" not in plan_text(by_time) and "Exchange" not in plan_text(by_id)


def test_series_without_a_key_uses_the_place_in_the_file(spark, tmp_path):
    """All rows are copies of one row, and still split into dense ordinals."""
    path = str(tmp_path / "copies")
    copies = spark.range(400).select(F.lit(at(1)).cast("timestamp_ntz").alias("ts"), F.lit("x").alias("v"))
    copies.repartition(4).write.parquet(path)
    ds = read_series(spark, path, database="d", table="t", time="ts")
    index = keyindex.build_index(ds.df, ds.order)
    assert len(index.counts) > 1 and max(index.counts) < 300
    numbered = keyindex.with_ordinal(ds.df, ds.order, index=index)
    assert sorted(r["rn"] for r in numbered.select("rn").collect()) == list(range(1, 401))
    assert ds.shown == ["ts", "v"]


def test_no_key_needs_parquet(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(3).write.json(path)
    with pytest.raises(ValueError, match="unique key"):
        read_series(spark, path, database="d", table="t", time="ts", format="json")
    ds = read_series(spark, path, database="d", table="t", time="id", keys=["id"], format="json")
    assert ds.df.count() == 3


def test_zoned_times_become_utc(spark):
    from sluicebox.functions.times import in_utc

    df = spark.sql("select timestamp '2024-01-01 02:00:00+02:00' as ts")
    assert in_utc(df).first()["ts"] == at(0)


def test_series_of_helper_hides_nothing(spark):
    assert series_of(timed(spark, [1])).shown == ["id", "ts"]
