from __future__ import annotations

import random

import numpy as np
import pytest

from sluicebox import MessageLog, export, scratch_dir
from sluicebox.operators.offsets import offsets_frame
from sluicebox.streaming import gaps
from tests.conftest import series_of, timed

LOG = "partition int, offset bigint"


def put(spark, path, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def report(frame):
    return sorted((r["partition"], r["kind"], r["first_offset"], r["end_offset"], r["messages"]) for r in frame.collect())


def plain(rows, start, end):
    out = []
    for p in start:
        mine = [o for q, o in rows if q == p and o is not None]
        at = start[p]
        while at < end[p]:
            if at in mine:
                if mine.count(at) > 1:
                    out.append((p, "repeat", at, at + 1, mine.count(at) - 1))
                at += 1
                continue
            stop = at
            while stop < end[p] and stop not in mine:
                stop += 1
            out.append((p, "gap", at, stop, stop - at))
            at = stop
    return sorted(out)


def test_runs_against_sets():
    rng = random.Random(3)
    for _ in range(300):
        seen, counts = set(), {}
        low = high = again = times = np.array([], np.int64)
        for _ in range(rng.randint(1, 5)):
            some = [rng.randint(-3, 25) for _ in range(rng.randint(1, 8))]
            offsets, n = np.unique(np.array(some, np.int64), return_counts=True)
            low, high, known = gaps.add_to_runs(low, high, offsets)
            assert known.tolist() == sorted(set(some) & seen)
            again, times = gaps.add_repeats(again, times, offsets, n - 1 + np.isin(offsets, known))
            seen |= set(some)
            for o in some:
                counts[o] = counts.get(o, 0) + 1
        assert [o for a, b in zip(low, high) for o in range(a, b)] == sorted(seen)
        assert all(a > b for a, b in zip(low[1:], high[:-1]))
        assert dict(zip(again.tolist(), times.tolist())) == {o: c - 1 for o, c in counts.items() if c > 1}


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_report_against_a_plain_walk_over_several_batches(spark, monkeypatch, block):
    monkeypatch.setattr(gaps.follow_offsets, "__defaults__", (block,))
    rng = random.Random(5)
    root = scratch_dir(spark, "gaps")
    start, end = {0: 2, 1: 0, 2: 5, 3: 0}, {0: 30, 1: 9, 2: 5, 3: 4}
    rows = []
    for _ in range(2):
        some = [(rng.randint(0, 2), rng.randint(0, 33)) for _ in range(30)] + [(0, None), (None, 3)]
        put(spark, f"{root}-in", some)
        rows += some
        stream = spark.readStream.schema(LOG).parquet(f"{root}-in")
        bounds = offsets_frame(spark, start), offsets_frame(spark, end)
        got = gaps.gaps_of_what_is_there(stream, *bounds, f"{root}-seen", f"{root}-checkpoint")
        assert report(got) == plain(rows, start, end)


def test_nothing_has_come(spark):
    root = scratch_dir(spark, "gaps")
    put(spark, f"{root}-in", [])
    stream = spark.readStream.schema(LOG).parquet(f"{root}-in")
    bounds = offsets_frame(spark, {0: 0, 1: 3}), offsets_frame(spark, {0: 5, 1: 3})
    got = gaps.gaps_of_what_is_there(stream, *bounds, f"{root}-seen", f"{root}-checkpoint")
    assert report(got) == [(0, "gap", 0, 5, 5)]


def test_it_ends_by_the_announced_count_while_the_topic_goes_on(spark):
    log = MessageLog(scratch_dir(spark, "gaps"), 3)
    first = export(series_of(timed(spark, range(90))), log, "t", jobs=6).offsets.collect()
    export(series_of(timed(spark, range(30))), log, "t", jobs=6)
    start = offsets_frame(spark, {r["partition"]: r["start_offset"] for r in first})
    end = offsets_frame(spark, {r["partition"]: r["end_offset"] for r in first})
    stream = log.read_stream(spark, "t")
    got = gaps.collect_until_complete(stream, start, end, f"{log.root}-seen", f"{log.root}-checkpoint", patience=60)
    assert got.count() == 0
    # What never comes ends it after a while, and is a gap.
    beyond = offsets_frame(spark, {r["partition"]: r["end_offset"] + 100 for r in first})
    late = gaps.collect_until_complete(stream, start, beyond, f"{log.root}-seen", f"{log.root}-checkpoint", patience=2)
    assert {r["kind"] for r in late.collect()} == {"gap"} and late.count() == 3
    assert sum(r["messages"] for r in late.collect()) == 300 - 30
