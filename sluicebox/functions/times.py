"""Time values and their text forms. All times are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text form of a time with milliseconds.
MS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def ms_text(ts: Column) -> Column:
    """``2024-01-01T00:00:07.179Z``; digits below the millisecond are cut."""
    return F.date_format(ts, MS_PATTERN)


def nano_text(ts: Column) -> Column:
    """RFC 3339 text with as many fraction digits as are not trailing zeros."""
    # The plain cast has the right digits already, with a blank before the time of day.
    return F.concat(F.overlay(ts.cast("string"), F.lit("T"), 11, 1), F.lit("Z"))


def parse_ms_text(text: Column, strict: bool = True) -> Column:
    """Time of an ``ms_text`` value; bad text raises, or is null if not ``strict``."""
    parsed = F.try_to_timestamp(text, F.lit(MS_PATTERN)).cast("timestamp_ntz")
    if not strict:
        return parsed
    message = F.concat(F.lit("not a time: "), text)
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def cut_to_ms(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts).cast("timestamp_ntz")


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 in UTC, cut and not rounded, in any session time zone."""
    return F.unix_millis(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def time_or_null(value: Column) -> Column:
    """The value as a time if it is one, else null."""
    return value.try_cast("timestamp_ntz")


def utc_time(instant: Column) -> Column:
    """A zoned TIMESTAMP as plain UTC time, from its microseconds: no zone of session or process plays a part."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def zoned_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]


def in_utc(df: DataFrame) -> DataFrame:
    """``df`` with zoned timestamps as plain UTC times, so that cut points round-trip exactly."""
    zoned = zoned_columns(df)
    return df.withColumns({c: utc_time(F.col(c)) for c in zoned}) if zoned else df


def exact_literal(value: object) -> Column:
    """A literal; a time goes in as text, so that no time zone can shift it."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def time_literal(value: datetime | date | str | Column) -> Column:
    """A caller's time bound as a TIMESTAMP_NTZ column; an offset (``Z``, ``+02:00``) is taken into account."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    elif not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return exact_literal(value)


def instant_literal(value: datetime | date | str | Column) -> Column:
    """A caller's time bound as a zoned TIMESTAMP, for a filter on a stored zoned column."""
    if isinstance(value, Column):
        return value
    plain = time_literal(value)
    return F.concat(plain.cast("string"), F.lit("+00:00")).cast("timestamp")
