"""Small tables that the driver makes: plans, offsets, bases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = {
    "int": pa.int32(),
    "bigint": pa.int64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"),
}


def small_table(spark: SparkSession, rows: Sequence[tuple], columns: Mapping[str, str]) -> DataFrame:
    """A local relation, which Spark can plan with and broadcast without a job of its own."""
    arrays = [
        pa.array([row[i] for row in rows], type=_ARROW[kind]) for i, kind in enumerate(columns.values())
    ]
    # Without its type a plain time would be taken for an instant, and shown in the zone of the process.
    schema = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)), schema)
