from __future__ import annotations

import pytest

from sluicebox.operators import offsets
from sluicebox.operators.collect import between_offsets, collect_messages

SUMMARIES = [
    ({0: 100}, {0: 200}, ["0:100:199"]),
    ({0: 100, 1: 50, 2: 0}, {0: 200, 1: 75, 2: 10}, ["0:100:199", "1:50:74", "2:0:9"]),
    ({0: 100}, {0: 100}, ["0:100:99"]),
    ({0: 0}, {0: 1}, ["0:0:0"]),
    ({0: 1_000_000}, {0: 5_000_000}, ["0:1000000:4999999"]),
    ({}, {}, []),
    ({0: 1, 1: 2}, {0: 5}, ["0:1:4"]),
    ({0: 1}, {0: 5, 1: 9}, ["0:1:4"]),
    ({2147483647: 0}, {2147483647: 100}, ["2147483647:0:99"]),
    ({-1: 0}, {-1: 10}, ["-1:0:9"]),
    (None, None, []),
]


@pytest.mark.parametrize("start, end, expected", SUMMARIES)
def test_offset_summary(spark, start, end, expected):
    both = offsets.offset_summary(offsets.offsets_frame(spark, start), offsets.offsets_frame(spark, end))
    rows = both.orderBy("partition").collect()
    assert [r["offset_str"] for r in rows] == sorted(expected)
    assert all(r["messages"] == r["end_offset"] - r["start_offset"] for r in rows)


def messages(spark, rows):
    return spark.createDataFrame([(p, o, v.encode()) for p, o, v in rows], "partition int, offset bigint, value binary")


def test_high_watermarks_know_empty_partitions(spark):
    log = messages(spark, [(0, 0, "a"), (0, 1, "b"), (2, 7, "c")])
    assert dict(offsets.high_watermarks(log, 4).collect()) == {0: 2, 1: 0, 2: 8, 3: 0}
    assert dict(offsets.high_watermarks(log, [2]).collect()) == {2: 8}


def test_audit_shows_what_is_missing(spark):
    produced = spark.createDataFrame([(0, 10), (1, 5)], "partition int, produced bigint")
    start, end = offsets.offsets_frame(spark, {0: 0, 1: 0, 2: 0}), offsets.offsets_frame(spark, {0: 10, 1: 4, 2: 0})
    audit = {r["partition"]: tuple(r)[1:] for r in offsets.delivery_audit(produced, start, end).collect()}
    assert audit == {0: (10, 10, True), 1: (5, 4, False), 2: (0, 0, True)}


def test_collect_sizes(spark):
    log = messages(spark, [(1, 0, "longer"), (0, 3, "é"), (0, 4, "xyz")])
    assert tuple(collect_messages(log).first()) == (3, 2, 6, 11)
    assert tuple(collect_messages(log.filter("offset > 99")).first()) == (0, 0, 0, 0)


def test_between_offsets(spark):
    log = messages(spark, [(p, o, "v") for p in range(3) for o in range(10)])
    start, end = offsets.offsets_frame(spark, {0: 2, 1: 9}), offsets.offsets_frame(spark, {0: 4, 1: 10, 2: 5})
    got = sorted((r["partition"], r["offset"]) for r in between_offsets(log, start, end).collect())
    assert got == [(0, 2), (0, 3), (1, 9)]


def test_unknown_partition_is_an_error(spark):
    from sluicebox.operators.keyindex import build_index

    df = spark.createDataFrame([(1, 0), (2, 5)], "k int, partition int")
    with pytest.raises(ValueError, match="partition 5"):
        offsets.with_offsets(df, build_index(df, ["k"]), offsets.offsets_frame(spark, {0: 0}))


def test_the_search_for_a_place_is_written_out_once(spark):
    from sluicebox.operators.keyindex import build_index
    from sluicebox.operators.split import TimePlan, assign_jobs

    df = spark.range(40_000).selectExpr(
        "timestampadd(MINUTE, id, timestamp_ntz'2024-01-01') AS ts", *[f"id * {i} AS c{i}" for i in range(1, 12)]
    )
    index = build_index(df, ["ts"], buckets=360)
    cuts = tuple(p[0] for p in index.points[6::7])
    jobs = assign_jobs(df, TimePlan("ts", cuts, None, None, 40_000, 1, True), 4)
    starts = offsets.offsets_frame(spark, dict.fromkeys(range(4), 0))
    placed, _ = offsets.with_offsets(jobs, index, starts)
    plan = placed._jdf.queryExecution().optimizedPlan()
    # The search is not written out once more to look for nulls.
    assert not any("pmod" in line for line in plan.toString().split("\n") if "Filter" in line)
    assert placed.count() == 40_000 and placed.select("partition", "offset").distinct().count() == 40_000
