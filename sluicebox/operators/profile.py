"""Count, time range, and first and last record of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.documents import members, value_text
from sluicebox.functions.times import cut_to_ms, exact_literal, ms_text, nano_text, time_or_null
from sluicebox.operators.filters import in_window
from sluicebox.operators.messages import ID_MEMBER
from sluicebox.sources.dataset import Dataset

Tag = tuple[str, object] | None
TimeWindow = tuple[object, object] | None


def _time_of(ds: Dataset) -> Column:
    """The dataset's time; null where the stored value is not a time."""
    column = F.col(ds.time)
    dtype = ds.df.schema[ds.time].dataType
    return column if isinstance(dtype, T.TimestampNTZType) else time_or_null(column)


def time_range(ds: Dataset, tag: Tag = None, window: TimeWindow = None) -> DataFrame:
    """One row ``start_str, end_str``; empty text without a time column, null without rows."""
    rows = ds.selected(tag, window)
    if ds.time is None:
        return rows.agg(F.lit("").alias("start_str"), F.lit("").alias("end_str"))
    ends = rows.agg(F.min(_time_of(ds)).alias("first"), F.max(_time_of(ds)).alias("last"))
    return ends.select(ms_text(F.col("first")).alias("start_str"), ms_text(F.col("last")).alias("end_str"))


def record_count(ds: Dataset, tag: Tag = None, window: TimeWindow = None) -> DataFrame:
    """One row ``record_count``."""
    return ds.selected(tag, window).agg(F.count("*").alias("record_count"))


def half_open_count(ds: Dataset, tag: Tag = None) -> DataFrame:
    """Rows between the first time and the last one, both cut to milliseconds.

    The stop is exclusive, so the last record is left out, as the text bounds of
    a time range would do.
    """
    rows = ds.selected(tag)
    ends = rows.agg(F.min(ds.time).alias("a"), F.max(ds.time).alias("b")).first()
    inside = in_window(rows, ds.time, cut_to_ms(exact_literal(ends["a"])), cut_to_ms(exact_literal(ends["b"])))
    return inside.agg(F.count("*").alias("record_count"))


def count_detail(ds: Dataset, tag: Tag = None) -> DataFrame:
    """One row ``time, value``: the number of records, stamped with the last time."""
    return ds.selected(tag).agg(F.max(_time_of(ds)).alias("time"), F.count("*").alias("value"))


def per_series_profile(
    ds: Dataset, series_keys: Sequence[str] | None = None, window: TimeWindow = None
) -> DataFrame:
    """Count and time range of each series, that is of each combination of tag values."""
    keys = list(series_keys or ds.series_keys)
    grouped = ds.selected(None, window).groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("record_count"),
        F.min(_time_of(ds)).alias("first_ts"),
        F.max(_time_of(ds)).alias("last_ts"),
    )


def first_last_records(ds: Dataset, tag: Tag = None, window: TimeWindow = None) -> DataFrame:
    """The first and the last row, as ``position`` ``first`` / ``last`` and the shown columns.

    The ends of the sort key come from a scan of the key columns; only then are
    the two rows read in full, by equality on the key.
    """
    rows = ds.selected(tag, window)
    return _rows_at_ends(ds, rows, _ends(ds, rows))


def dataset_detail(ds: Dataset, tag: Tag = None, window: TimeWindow = None) -> DataFrame:
    """One row: range, names, count, sorted columns, and the first and last record.

    ``data`` holds two rows of values as text, in the order of ``columns``. A
    dataset without rows gives count 0 and nulls. Documents without a schema have
    the columns of the first one, without its id; what the last one lacks is null.
    """
    rows = ds.selected(tag, window)
    ends = _ends(ds, rows)
    at_ends = _rows_at_ends(ds, rows, ends)
    if ds.document is not None:
        # Two documents at most.
        pairs = at_ends.agg(F.sort_array(F.collect_list(F.struct("position", ds.document))).alias("p"))
        first = members(F.get("p", F.lit(0))[ds.document])
        columns = F.array_sort(F.filter(F.map_keys(first), lambda k: k != ID_MEMBER))
        names = F.coalesce(columns, F.array().cast("array<string>"))

        def values_of(pair: Column) -> Column:
            own = members(pair[ds.document])
            texts = F.transform(columns, lambda k: _member_text(F.try_element_at(own, k)))
            return F.struct(pair["position"].alias("position"), texts.alias("v"))

        data = pairs.select(names.alias("names"), F.transform("p", values_of).alias("pairs"))
    else:
        values = F.array(*[_as_text(c, ds.df.schema[c].dataType) for c in ds.shown])
        data = at_ends.agg(
            F.lit(ds.shown).cast("array<string>").alias("names"),
            F.sort_array(F.collect_list(F.struct("position", values.alias("v")))).alias("pairs"),
        )
    has_time = ds.time is not None
    first_ts, last_ts = (_end_time(ds, ends, "low"), _end_time(ds, ends, "high")) if has_time else (None, None)
    return data.select(
        (nano_text(first_ts) if has_time else F.lit("")).alias("start"),
        (nano_text(last_ts) if has_time else F.lit("")).alias("end"),
        F.lit(ds.database).alias("bucket"),
        F.lit(ds.table).alias("measurement"),
        F.lit(ends["n"]).cast("bigint").alias("count"),
        F.array_sort("names").alias("columns"),
        F.transform("pairs", lambda p: p["v"]).alias("data"),
    )


def _sort_key(ds: Dataset) -> tuple[str, ...]:
    if ds.time is not None and ds.time not in ds.order:
        return (ds.time, *ds.order)
    return ds.order


def _ends(ds: Dataset, rows: DataFrame):
    """Count and both ends of the sort key: one row, from the key columns only."""
    key = F.struct(*_sort_key(ds))
    return rows.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()


def _end_time(ds: Dataset, ends, side: str) -> Column:
    value = ends[side][ds.time] if ends["n"] else None
    dtype = ds.df.schema[ds.time].dataType
    return time_or_null(exact_literal(value).cast(dtype))


def _rows_at_ends(ds: Dataset, rows: DataFrame, ends) -> DataFrame:
    def at(end) -> Column:
        condition = F.lit(ends["n"] > 0)
        for name in _sort_key(ds):
            dtype = ds.df.schema[name].dataType
            value = end[name] if ends["n"] else None
            condition = condition & F.col(name).eqNullSafe(exact_literal(value).cast(dtype))
        return condition

    both = at(ends["low"]) | at(ends["high"])
    sides = F.concat(
        F.when(at(ends["low"]), F.array(F.lit("first"))).otherwise(F.array().cast("array<string>")),
        F.when(at(ends["high"]), F.array(F.lit("last"))).otherwise(F.array().cast("array<string>")),
    )
    found = rows.filter(both).select(F.explode(sides).alias("position"), *ds.shown)
    return found


def _member_text(value: Column) -> Column:
    """A member's value as text: a string without quotes, null for a null, JSON for all else."""
    text = value_text(value)
    return F.when(text.startswith('"'), value.try_cast("string")).when(text != "null", text)


def _as_text(name: str, dtype: T.DataType) -> Column:
    column = F.col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return nano_text(column)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")
