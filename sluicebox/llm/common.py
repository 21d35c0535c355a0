"""Helpers the operators share: written tables, whole-text Arrow batches, hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.session import scratch_dir

#: A word of the contracts: a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe to read again after a lost executor."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, bytes_per_task: int = 64 << 20) -> int:
    """Partitions for a shuffle of ``df``: by the size of its files, at least the session's own number.

    A frame that is not read from files has no known size; the planner then
    answers with one beyond any table, and the session's number holds.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 53 else max(least, -(-size // bytes_per_task))


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict], Iterator[tuple]]], schema: str, rows: int = 512
) -> DataFrame:
    """Rows of ``schema`` for each row of ``df``, one Arrow batch at a time.

    ``make()`` runs once per task and gives the function that turns a row (a
    dict) into output tuples; output goes on after every ``rows`` rows, so a
    batch of long texts is never held twice.
    """
    spark = df.sparkSession
    target = _arrow_schema(spark, schema)

    def run(batches):
        each = make()
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for row in batch.slice(at, rows).to_pylist():
                    out.extend(each(row))
                    if len(out) >= rows:
                        yield _batch(out, target)
                        out = []
        if out:
            yield _batch(out, target)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def remainder_of_crc32(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def remainder_in_python(value, modulus: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % modulus


class BoundedCache(dict):
    """A dict that starts anew when it holds ``limit`` entries; its content is only ever a saving of time."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def make_room(self, wanted: int) -> None:
        if len(self) + wanted > self.limit:
            self.clear()
