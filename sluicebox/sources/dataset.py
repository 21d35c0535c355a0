"""What a stored dataset is: a DataFrame plus the roles of its columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.documents import has_member, member_time
from sluicebox.functions.times import in_utc
from sluicebox.operators import filters

SERIES = "series"
COLLECTION = "collection"

# Physical place of a row in its file: the tie-break of tables without a unique key.
ROW_FILE = "_row_file"
ROW_POS = "_row_pos"
# The time of a document, taken out of its text.
DOCUMENT_TIME = "_document_time"


@dataclass(frozen=True)
class Dataset:
    """A time series or a document collection.

    ``keys`` make the order unique: for a collection they are its id, for a
    series they break ties of ``time``. ``hidden`` columns serve the order only
    and never reach a message. ``json_columns`` hold JSON text. A collection whose
    documents differ in their keys has them as text in the column ``document``; then
    tags and messages are about the members of the documents. Zoned timestamps
    of ``df`` become plain UTC times; ``stored`` is the frame as it was given.
    """

    df: DataFrame
    database: str
    table: str
    kind: str = SERIES
    time: str | None = None
    keys: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    series_keys: tuple[str, ...] = ()
    json_columns: tuple[str, ...] = ()
    document: str | None = None
    stored: DataFrame = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "stored", self.df)
        object.__setattr__(self, "df", in_utc(self.df))

    @property
    def order(self) -> tuple[str, ...]:
        """The unique sort key: time first for a series, the id for a collection."""
        if self.kind == SERIES:
            return (self.time, *self.keys)
        return self.keys

    @property
    def shown(self) -> list[str]:
        """The columns a reader sees, sorted by name."""
        return sorted(c for c in self.df.columns if c not in self.hidden)

    def selected(
        self,
        tag: tuple[str, object] | None = None,
        window: tuple[object, object] | None = None,
        *,
        timeless: bool = False,
    ) -> DataFrame:
        """The rows with the tag value and inside the half-open time window.

        A record of a series has a time; rows without one are not part of it and
        only come along if ``timeless`` asks for them.
        """
        df = self.df
        if window is not None:
            if self.time is None:
                raise ValueError(f"{self.table} has no time column to cut a window from")
            # On the stored column, where the scan can use it; converted afterwards.
            df = in_utc(filters.in_window(self.stored, self.time, *window))
        if self.kind == SERIES and not timeless:
            df = df.filter(F.col(self.time).isNotNull())
        if self.document is not None and tag and tag[0] and tag[1] not in (None, ""):
            return df.filter(has_member(F.col(self.document), tag[0], str(tag[1])))
        return filters.tagged(df, tag, as_text=self.kind == SERIES)

    def without_time(self, tag: tuple[str, object] | None = None) -> int:
        """Records of a series that have no time and so are no part of it."""
        if self.kind != SERIES:
            return 0
        timeless = self.df.filter(F.col(self.time).isNull())
        return filters.tagged(timeless, tag).count()

    def with_df(self, df: DataFrame) -> Dataset:
        return replace(self, df=df)


def read_series(
    spark: SparkSession,
    path: str,
    *,
    database: str,
    table: str,
    time: str,
    keys: Sequence[str] = (),
    series_keys: Sequence[str] = (),
    json_columns: Sequence[str] = (),
    format: str = "parquet",
    **options: str,
) -> Dataset:
    """A wide table with a time column, as a series."""
    df, keys, hidden = _read(spark, path, keys, format, options)
    return Dataset(
        df,
        database,
        table,
        SERIES,
        time,
        keys,
        hidden,
        tuple(series_keys),
        tuple(json_columns),
    )


def read_collection(
    spark: SparkSession,
    path: str,
    *,
    database: str,
    table: str,
    keys: Sequence[str] = (),
    time: str | None = None,
    hide_keys: bool = False,
    json_columns: Sequence[str] = (),
    format: str = "parquet",
    **options: str,
) -> Dataset:
    """A table of documents with a unique id; ``hide_keys`` keeps the id out of messages."""
    df, keys, hidden = _read(spark, path, keys, format, options)
    if hide_keys:
        hidden = tuple({*hidden, *keys})
    return Dataset(
        df,
        database,
        table,
        COLLECTION,
        time,
        keys,
        hidden,
        (),
        tuple(json_columns),
    )


def documents_of(
    df: DataFrame,
    *,
    database: str,
    table: str,
    document: str,
    keys: Sequence[str],
    time_member: str | None = None,
) -> Dataset:
    """A collection of JSON texts with key sets of their own, in the order of the columns ``keys``.

    ``time_member`` names the member that holds a document's time.
    """
    picked = df.select(*keys, document)
    hidden = tuple(keys)
    if time_member is not None:
        picked = picked.withColumn(DOCUMENT_TIME, member_time(F.col(document), time_member))
        hidden = (*hidden, DOCUMENT_TIME)
    time = DOCUMENT_TIME if time_member is not None else None
    return Dataset(picked, database, table, COLLECTION, time, tuple(keys), hidden, document=document)


def measurement_rows(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of one measurement out of a table that holds several."""
    return df.filter(F.col(column) == F.lit(name)).drop(column)


def long_form(ds: Dataset, fields: Sequence[str], tags: Sequence[str] = ()) -> DataFrame:
    """A wide series as one row per field: ``_time, _measurement, tags, _field, _value``."""
    ids = [F.col(ds.time).alias("_time"), F.lit(ds.table).alias("_measurement"), *map(F.col, tags)]
    wide = ds.df.select(*ids, *[F.col(f).cast("double").alias(f) for f in fields])
    return wide.unpivot(["_time", "_measurement", *tags], list(fields), "_field", "_value")


def _read(
    spark: SparkSession, path: str, keys: Sequence[str], format: str, options: dict[str, str]
) -> tuple[DataFrame, tuple[str, ...], tuple[str, ...]]:
    df = spark.read.format(format).options(**options).load(path)
    if keys:
        return df, tuple(keys), ()
    if format != "parquet":
        raise ValueError(f"give the unique key of {path}: only parquet rows have a place of their own")
    place: list[Column] = [
        F.xxhash64("_metadata.file_path").alias(ROW_FILE),
        F.col("_metadata.row_index").alias(ROW_POS),
    ]
    return df.select("*", *place), (ROW_FILE, ROW_POS), (ROW_FILE, ROW_POS)
