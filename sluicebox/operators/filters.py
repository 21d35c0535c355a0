"""Row filters. All are Column conditions, so they reach the scan where they can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.times import instant_literal, time_literal
from sluicebox.tables import small_table


def in_window(df: DataFrame, time: str, start: object = None, stop: object = None) -> DataFrame:
    """Rows with ``start <= time < stop``; a bound of ``None`` is open. Zoned columns compare as instants."""
    zoned = isinstance(df.schema[time].dataType, T.TimestampType)
    bound = instant_literal if zoned else time_literal
    if start is not None:
        df = df.filter(F.col(time) >= bound(start))
    if stop is not None:
        df = df.filter(F.col(time) < bound(stop))
    return df


def tagged(df: DataFrame, tag: tuple[str, object] | None, *, as_text: bool = True) -> DataFrame:
    """Rows whose tag column has the value; an empty key or value filters nothing.

    A series compares text with text. A collection compares in the column's own
    type; a value that is not of that type matches nothing.
    """
    key, value = tag or ("", "")
    if not key or value is None or value == "":
        return df
    dtype = df.schema[key].dataType
    return df.filter(_tag_condition(F.col(key), dtype, str(value), as_text))


def _tag_condition(column: Column, dtype: T.DataType, value: str, as_text: bool) -> Column:
    if isinstance(dtype, T.StringType):
        return column == F.lit(value)
    typed = F.lit(value).try_cast(dtype)
    if not as_text:
        return column == typed
    if isinstance(dtype, T.IntegralType):
        # Same as comparing text, but a plain compare that can reach the scan.
        return (column == typed) & (typed.cast("string") == F.lit(value))
    return column.cast("string") == F.lit(value)


def without_names(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` is not one of ``names``."""
    if not names:
        return df
    excluded = small_table(df.sparkSession, [(n,) for n in names], {column: "string"})
    return df.join(F.broadcast(excluded), column, "left_anti")
