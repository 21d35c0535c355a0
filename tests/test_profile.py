from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluicebox import Dataset, batch_records, dataset_catalog, dataset_detail, first_last_records, long_form, time_range
from sluicebox.operators.catalog import list_files, list_tables
from sluicebox.operators.profile import count_detail, half_open_count, per_series_profile
from tests.conftest import at, plan_text, series_of, timed


def test_detail(spark):
    ds = series_of(timed(spark, [3, 1.5, 2]))
    row = dataset_detail(ds).first()
    assert row.asDict() == {
        "start": "2024-01-01T00:00:01.5Z",
        "end": "2024-01-01T00:00:03Z",
        "bucket": "db",
        "measurement": "t",
        "count": 3,
        "columns": ["id", "ts"],
        "data": [["1", "2024-01-01T00:00:01.5Z"], ["0", "2024-01-01T00:00:03Z"]],
    }


def test_detail_of_nothing(spark):
    row = dataset_detail(series_of(timed(spark, []))).first()
    assert (row["count"], row["start"], row["end"], row["data"]) == (0, None, None, [])
    assert tuple(time_range(series_of(timed(spark, []))).first()) == (None, None)


def test_detail_of_one_row_gives_it_twice(spark):
    ds = series_of(timed(spark, [1]))
    assert dataset_detail(ds).first()["data"] == [["0", "2024-01-01T00:00:01Z"]] * 2
    assert sorted(r["position"] for r in first_last_records(ds).collect()) == ["first", "last"]


def test_time_column_that_holds_no_times(spark):
    df = spark.createDataFrame([(1, "a"), (2, "2024-01-01 00:00:05"), (3, "b")], "id int, ts string")
    ds = Dataset(df, "db", "c", "collection", "ts", ("id",))
    assert tuple(time_range(ds).first()) == ("2024-01-01T00:00:05.000Z",) * 2
    row = dataset_detail(ds).first()
    assert row["count"] == 3 and row["end"] is None
    numbers = Dataset(spark.createDataFrame([(1, 5)], "id int, ts int"), "db", "c", "collection", None, ("id",))
    assert tuple(time_range(numbers).first()) == ("", "")


def test_half_open_count(spark):
    assert half_open_count(series_of(timed(spark, range(10)))).first()[0] == 9
    # The last two share a millisecond, so both are left out.
    assert half_open_count(series_of(timed(spark, [1, 2, 3.0001, 3.0002]))).first()[0] == 2
    assert half_open_count(series_of(timed(spark, []))).first()[0] == 0


def test_count_detail(spark):
    assert tuple(count_detail(series_of(timed(spark, [5, 1]))).first()) == (at(5), 2)


def test_per_series(spark):
    ds = series_of(timed(spark, range(6)).withColumn("s", F.col("id") % 2), series_keys=("s",))
    rows = sorted(tuple(r) for r in per_series_profile(ds).collect())
    assert rows == [(0, 3, at(0), at(4)), (1, 3, at(1), at(5))]


def test_first_and_last_are_looked_up_by_key(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    ds = Dataset(df, "db", "documents", "collection", None, ("doc_id",))
    text = plan_text(first_last_records(ds))
    assert "Exchange" not in text and "EqualNullSafe(doc_id" in text


def test_window_needs_a_time(spark):
    ds = Dataset(timed(spark, [1]), "db", "c", "collection", None, ("id",))
    with pytest.raises(ValueError, match="no time column"):
        ds.selected(window=(at(0), at(1)))


def test_long_form(spark):
    df = timed(spark, [1]).withColumns({"a": F.lit(1), "b": F.lit(2.5), "tag": F.lit("x")})
    rows = [tuple(r) for r in long_form(series_of(df), ["a", "b"], ["tag"]).orderBy("_field").collect()]
    assert rows == [(at(1), "t", "x", "a", 1.0), (at(1), "t", "x", "b", 2.5)]


@pytest.mark.parametrize(
    "rows, size, sizes",
    [(0, 3, []), (2, 3, [2]), (3, 3, [3]), (7, 3, [3, 3, 1]), (3, 1, [1, 1, 1]), (2, 100, [2])],
)
def test_batches(spark, rows, size, sizes):
    df = spark.range(rows).select((rows - F.col("id")).alias("k"), F.lit(None).cast("string").alias("v"))
    got = batch_records(df, ["k"], size).orderBy("batch_id").collect()
    assert [r["n"] for r in got] == sizes == [len(r["records"]) for r in got]
    assert [x["k"] for r in got for x in r["records"]] == list(range(1, rows + 1))
    assert all((r["first_key"], r["last_key"]) == (r["records"][0]["k"], r["records"][-1]["k"]) for r in got)


@pytest.mark.parametrize("size", [0, -1])
def test_batch_size_must_be_positive(spark, size):
    with pytest.raises(ValueError):
        batch_records(spark.range(3), ["id"], size)


def test_catalog_skips_system_databases(spark):
    mine = series_of(timed(spark, [1, 2]))
    hidden = series_of(timed(spark, [1]), database="admin")
    rows = dataset_catalog([mine, hidden]).collect()
    assert len(rows) == 1
    assert rows[0]["dataset_params"] == {"bucket": "db", "measurement": "t"}
    assert (rows[0]["dataset_name"], rows[0]["record_count"]) == ("db:t", 2)
    assert rows[0]["dataset_description"] == "Measurement 't' in bucket 'db'"


def test_list_files(spark, tmp_path):
    spark.range(5).repartition(2).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "single.parquet"))
    listed = {r["table_name"]: (r["files"], r["bytes"] > 0) for r in list_files(spark, str(tmp_path)).collect()}
    assert listed == {"many": (2, True), "single": (1, True)}


def test_list_files_of_the_test_tables(spark, sf):
    names = {r["table_name"] for r in list_files(spark, sf).collect()}
    assert {"events", "orders", "lineitem", "documents"} <= names and len(names) == 14


def test_list_tables(spark):
    spark.range(1).createOrReplaceTempView("only_a_view")
    assert "only_a_view" not in {r["table_name"] for r in list_tables(spark).collect()}


def test_catalog_counts_the_rows_of_the_detail(spark):
    df = spark.createDataFrame([(1, at(1)), (2, at(2)), (3, None)], "id bigint, ts timestamp_ntz")
    ds = series_of(df)
    assert dataset_catalog([ds]).first()["record_count"] == ds.selected().count() == 2
