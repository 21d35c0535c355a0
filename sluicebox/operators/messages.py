"""Rows as messages: one JSON object per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.documents import document_text
from sluicebox.functions.jsontext import json_text
from sluicebox.sources.dataset import SERIES, Dataset

# The label that document messages carry, and the member they lose.
SOURCE_LABEL = "mongodb"
ID_MEMBER = "_id"


def message_fields(ds: Dataset, nested: bool = False) -> dict[str, Column]:
    """The members of a message of ``ds``.

    A series gets ``_time`` and ``_measurement``. A collection loses its hidden
    id and gets ``_source``, ``_collection`` and ``_database``, which replace
    columns of the same name. ``nested`` writes JSON text columns as JSON and
    not as quoted text.
    """
    fields = {c: F.col(c) for c in ds.shown}
    if nested:
        fields.update({c: F.try_parse_json(F.col(c)) for c in ds.json_columns})
    if ds.kind == SERIES:
        fields["_time"] = fields.pop(ds.time)
        fields["_measurement"] = F.lit(ds.table)
    else:
        fields.update({name: F.lit(label) for name, label in _labels(ds).items()})
    return fields


def _labels(ds: Dataset) -> dict[str, str]:
    return {"_source": SOURCE_LABEL, "_collection": ds.table, "_database": ds.database}


def with_value(
    df: DataFrame, ds: Dataset, extra: Sequence[str] = (), nested: bool = False
) -> DataFrame:
    """The ``extra`` columns and ``value``, the JSON text of each row."""
    if ds.document is not None:
        value = document_text(F.col(ds.document), _labels(ds), drop=(ID_MEMBER,))
    else:
        value = json_text(df, message_fields(ds, nested))
    return df.select(*extra, value.alias("value"))


def series_messages(ds: Dataset, df: DataFrame | None = None, nested: bool = False) -> DataFrame:
    """``value`` of each row of a series, or of the rows ``df`` of it."""
    return with_value(ds.df if df is None else df, ds, nested=nested)


def document_messages(ds: Dataset, df: DataFrame | None = None, nested: bool = False) -> DataFrame:
    """``value`` of each document, without its internal id."""
    return with_value(ds.df if df is None else df, ds, nested=nested)
