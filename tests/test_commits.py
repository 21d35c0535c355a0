"""The commit log: whole runs or nothing, one writer at a time, offsets without a look at messages."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from sluicebox import MessageLog, export, scratch_dir
from sluicebox.plans import export as exports
from sluicebox.sources import logsource, manifest
from sluicebox.sources.manifest import ConcurrentWrite, HadoopStore, NotDense
from sluicebox.streaming import readers
from tests.conftest import plan_text, series_of, timed


@pytest.fixture
def log(spark):
    return MessageLog(scratch_dir(spark, "commits"), 3)


def rows(spark, offsets):
    data = [(p, o, f"{p}:{o}") for p, o in offsets]
    return spark.createDataFrame(data, "partition int, offset bigint, value string")


def there(df):
    return sorted((r["partition"], r["offset"]) for r in df.collect())


def ends(spark, log, topic="t"):
    return dict(log.high_watermarks(spark, topic).collect())


def test_a_half_written_run_is_never_read(spark, log, monkeypatch):
    log.write(rows(spark, [(0, 0), (0, 1), (2, 0)]), "t")

    def fail(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as broken:
        broken.setattr(manifest, "commit", fail)
        with pytest.raises(OSError):
            log.write(rows(spark, [(0, 2), (1, 0)]), "t", "lost")
    assert (Path(log.root) / "topic=t" / "run_id=lost").exists()
    want = [(0, 0), (0, 1), (2, 0)]
    assert there(log.read(spark, "t")) == want and ends(spark, log) == {0: 2, 1: 0, 2: 1}
    assert there(log.read_between(spark, "t", "earliest", "latest")) == want
    drained = readers.drain_to_table(log.read_stream(spark, "t"), f"{log.root}-o", f"{log.root}-c")
    assert there(drained) == want
    log.write(rows(spark, [(0, 2), (1, 0)]), "t")
    assert there(log.read(spark, "t")) == sorted([*want, (0, 2), (1, 0)])
    drained = readers.drain_to_table(log.read_stream(spark, "t"), f"{log.root}-o", f"{log.root}-c")
    assert there(drained) == there(log.read(spark, "t"))


def test_the_second_of_two_writers_is_refused(spark, log):
    base = log.snapshot(spark, "t")
    log.write(rows(spark, [(0, 0)]), "t", base=base)
    with pytest.raises(ConcurrentWrite):
        log.write(rows(spark, [(0, 0), (1, 0)]), "t", base=base)
    assert there(log.read(spark, "t")) == [(0, 0)] and ends(spark, log) == {0: 1, 1: 0, 2: 0}


def test_an_export_that_was_overtaken_is_refused(spark, log, monkeypatch):
    ds, build = series_of(timed(spark, range(12))), exports.build_messages

    def overtaken(*args, **options):
        log.write(rows(spark, [(1, 0)]), "t")
        return build(*args, **options)

    monkeypatch.setattr(exports, "build_messages", overtaken)
    with pytest.raises(ConcurrentWrite):
        export(ds, log, "t", jobs=6)
    monkeypatch.undo()
    assert there(log.read(spark, "t")) == [(1, 0)]
    assert export(ds, log, "t", jobs=6).audit.filter("not matches").isEmpty()
    assert ends(spark, log)[1] == 5


def test_one_of_many_writers_of_a_version_wins(spark, log):
    base = log.snapshot(spark, "t")
    store = HadoopStore(spark, f"{log.root}/topic=t")

    def attempt(k):
        try:
            return manifest.commit(store, base, f"run-{k}", {0: k + 1}).version
        except ConcurrentWrite:
            return None

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(attempt, range(16)))
    assert sorted(g for g in got if g) == [1]
    assert store.names() == [manifest.entry_name(1)] and log.snapshot(spark, "t").runs == (f"run-{got.index(1)}",)


@pytest.mark.parametrize("offsets", [[(0, 1)], [(0, 0), (0, 2)], [(0, 0), (0, 0)], [(1, 0), (1, 1), (1, 1), (1, 3)]])
def test_gaps_and_repeats_are_not_committed(spark, log, offsets):
    with pytest.raises(NotDense):
        log.write(rows(spark, offsets), "t")
    assert log.read(spark, "t").isEmpty() and set(ends(spark, log).values()) == {0}


def test_offsets_come_without_a_scan(spark, log):
    log.write(rows(spark, [(0, 0)]), "t")
    assert "Scan parquet" not in plan_text(log.high_watermarks(spark, "t"))


def test_a_topic_as_it_was(spark, log):
    for k in range(3):
        log.write(rows(spark, [(0, k)]), "t")
    assert there(log.read(spark, "t", version=2)) == [(0, 0), (0, 1)]
    assert log.snapshot(spark, "t", 1).ends == {0: 1} and log.snapshot(spark, "t", 0).runs == ()


def test_lists_of_runs_spare_old_entries(spark, log, monkeypatch):
    monkeypatch.setattr(manifest, "LIST_EVERY", 3)
    store = HadoopStore(spark, f"{log.root}/topic=t")
    at = manifest.snapshot(store)
    read = []
    text = HadoopStore.text
    for k in range(8):
        at = manifest.commit(store, at, f"run-{k}", {k % 2: k + 1})
        monkeypatch.setattr(HadoopStore, "text", lambda self, name: read.append(name) or text(self, name))
        assert manifest.snapshot(store) == at
        monkeypatch.setattr(HadoopStore, "text", text)
        assert len(read) <= 3
        read.clear()
    arrow = logsource.ArrowStore(f"{log.root}/topic=t")
    assert manifest.snapshot(arrow) == at and at.ends == {0: 7, 1: 8}


def test_an_empty_run_is_a_run(spark, log):
    log.write(rows(spark, [(0, 0)]).filter("false"), "t")
    assert log.snapshot(spark, "t").version == 1 and log.read(spark, "t").isEmpty()
    log.write(rows(spark, [(0, 0)]), "t")
    assert there(log.read_between(spark, "t", "earliest", "latest")) == [(0, 0)]


def test_only_files_with_wanted_offsets_are_opened(spark, log):
    for k in range(4):
        log.write(rows(spark, [(0, 2 * k), (0, 2 * k + 1), (1, k)]), "t")
    folder = f"{log.root}/topic=t"
    stretches = logsource.plan_stretches(folder, {0: 3, 1: 4}, {0: 5, 1: 4, 2: 9})
    assert [(s.partition, s.low, s.high) for s in stretches] == [(0, 3, 5)] and len(stretches[0].paths) >= 2
    opened = {path.split("run_id=")[1].split("/")[0] for s in stretches for path in s.paths}
    assert opened == set(log.snapshot(spark, "t").runs[1:3])
    assert there(log.read_between(spark, "t", {0: 3, 1: 4}, {0: 5, 1: 4, 2: 9})) == [(0, 3), (0, 4)]


@pytest.mark.parametrize("most", [1, 3, 100])
def test_small_files_share_a_task(spark, log, monkeypatch, most):
    for k in range(6):
        log.write(rows(spark, [(0, k)]), "t")
    monkeypatch.setattr(logsource, "TASK_MESSAGES", most)
    stretches = logsource.plan_stretches(f"{log.root}/topic=t", {0: 0}, {0: 6})
    assert len(stretches) == -(-6 // most)
    assert sorted(b["offset"][i].as_py() for s in stretches for b in logsource.read_stretch(s, "t") for i in range(b.num_rows)) == list(range(6))


def test_messages_are_those_of_the_plain_read(spark, log):
    export(series_of(timed(spark, range(50))), log, "t", jobs=6)
    by_offsets = log.read_between(spark, "t", "earliest", "latest")
    assert by_offsets.dtypes == log.read(spark, "t").dtypes
    assert by_offsets.exceptAll(log.read(spark, "t")).isEmpty() and by_offsets.count() == 50


def stream_rows(spark, log, name, **options):
    return there(readers.drain_to_table(log.read_stream(spark, "t", **options), f"{log.root}-{name}", f"{log.root}-{name}-c"))


def test_a_stream_from_latest_and_from_given_offsets(spark, log):
    log.write(rows(spark, [(0, 0), (0, 1), (1, 0)]), "t")
    assert stream_rows(spark, log, "latest", starting="latest") == []
    assert stream_rows(spark, log, "given", starting={0: 1, 1: 2}) == [(0, 1)]
    log.write(rows(spark, [(0, 2), (1, 1), (1, 2)]), "t")
    assert stream_rows(spark, log, "latest", starting="latest") == [(0, 2), (1, 1), (1, 2)]
    # Offset 1 of partition 1 lies before the wanted start, though it came later.
    assert stream_rows(spark, log, "given", starting={0: 1, 1: 2}) == [(0, 1), (0, 2), (1, 2)]


def test_a_restarted_stream_loses_and_repeats_nothing(spark, log):
    want = []
    for k in range(4):
        new = [(p, k) for p in range(3)]
        log.write(rows(spark, new), "t")
        want += new
        got = readers.drain_to_table(log.read_stream(spark, "t"), f"{log.root}-r", f"{log.root}-rc")
        assert there(got) == sorted(want)


def test_entries_are_plain_text(spark, log):
    log.write(rows(spark, [(0, 0), (2, 0)]), "t", "run-a")
    entry = json.loads(HadoopStore(spark, f"{log.root}/topic=t").text(manifest.entry_name(1)))
    assert entry == {"version": 1, "run_id": "run-a", "start": {"0": 0, "2": 0}, "end": {"0": 1, "2": 1}}
