"""What an export leaves out is counted and kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicebox import MessageLog, export, scratch_dir
from sluicebox.operators.keyindex import KeyIndex, _merged, build_index, with_ordinal
from sluicebox.streaming.readers import drain_counts, running_counts
from tests.conftest import plan_text, series_of, timed


def _export(spark, df, **options):
    log = MessageLog(scratch_dir(spark, "accounting"), 2)
    changes = {k: options.pop(k) for k in ("json_columns",) if k in options}
    return export(series_of(df, **changes), log, "t", jobs=4, **options)


def test_text_that_is_no_json_is_sent_unless_nested(spark):
    df = timed(spark, range(20)).withColumn("j", F.when(F.col("id") % 4 == 0, "no {").otherwise('{"a": 1}'))
    plain = _export(spark, df, json_columns=("j",)).accounting.first()
    assert tuple(plain) == (20, 20, 0, 0, 0, True)
    result = _export(spark, df, json_columns=("j",), nested=True)
    assert tuple(result.accounting.first()) == (20, 15, 5, 0, 0, True)
    assert {r["id"] for r in result.rejects.collect()} == {0, 4, 8, 12, 16}


def test_rows_without_time_and_behind_the_last_cut_are_counted(spark):
    df = timed(spark, range(10)).unionByName(spark.sql("select 99L as id, cast(null as timestamp_ntz) as ts"))
    done = _export(spark, df, drop_last=False, keep_tail=False).accounting.first()
    assert done["without_time"] == 1 and done["planned"] == 10
    assert done["produced"] + done["after_last_cut"] == 10 and done["matches"]


def test_rejects_of_rows_dealt_in_turn(spark):
    df = timed(spark, range(10)).withColumn("x", F.when(F.col("id") == 3, float("nan")).otherwise(1.0))
    done = _export(spark, df, strategy="row").accounting.first()
    assert tuple(done) == (10, 9, 1, 0, 0, True)


def test_shuffle_width_follows_the_index(spark):
    df = timed(spark, range(100))
    wide = KeyIndex(("ts", "id"), ((df.first()["ts"],),), (40_000_000, 60_000_000))
    assert wide.tasks(df) == 100
    numbered = with_ordinal(df, ["ts", "id"], index=build_index(df, ["ts", "id"], buckets=3))
    assert "REPARTITION_BY_NUM" in plan_text(numbered)


def test_many_ranges_are_merged_and_not_given_up():
    runs = [[10 * k, 10 * k + 1] for k in range(100)]
    merged = _merged(runs, 64)
    assert len(merged) == 64 and merged[0][0] == 0 and merged[-1][1] == 991
    assert all(any(a <= low and high <= b for a, b in merged) for low, high in runs)


def test_stream_of_a_topic_nobody_wrote_to(spark, tmp_path):
    log = MessageLog(str(tmp_path / "log"), 2)
    counts = running_counts(log.read_stream(spark, "t"))
    assert drain_counts(counts, str(tmp_path / "state"), str(tmp_path / "check")).count() == 0
