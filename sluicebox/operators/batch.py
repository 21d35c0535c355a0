"""Rows grouped into batches of a fixed size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicebox.functions.numbers import int_div
from sluicebox.functions.times import in_utc
from sluicebox.operators.keyindex import BUCKET, KeyIndex, aligned_index, build_index


def batch_records(
    df: DataFrame,
    keys: Sequence[str],
    size: int,
    columns: Sequence[str] | None = None,
    index: KeyIndex | None = None,
) -> DataFrame:
    """Batches of ``size`` rows in key order, the last one shorter; no rows, no batches.

    Result: ``batch_id, n, first_key, last_key, records``, the records in order.
    Rows are dealt in ranges of whole batches, so the one exchange that orders them
    also brings each batch together. A batch never holds more than ``size`` rows, so
    no task gets an unbounded group.
    """
    if size < 1:
        raise ValueError("a batch holds at least one row")
    columns = list(columns or df.columns)
    needed = in_utc(df.select(*dict.fromkeys([*keys, *columns])))
    index = index or build_index(needed, keys)
    whole = aligned_index(needed, index, size, index.tasks(df))
    base = F.broadcast(whole.bases(needed, "_base"))
    within = W.partitionBy(BUCKET).orderBy(*keys)
    numbered = whole.spread(needed).withColumn("_at", F.row_number().over(within) - 1)
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    # Grouped within the bucket, which is how the rows already lie.
    grouped = numbered.groupBy(BUCKET, int_div(F.col("_at"), size).alias("_batch")).agg(
        F.count("*").alias("n"),
        F.min_by(key, "_at").alias("first_key"),
        F.max_by(key, "_at").alias("last_key"),
        F.array_sort(F.collect_list(F.struct("_at", F.struct(*columns).alias("record")))).alias("pairs"),
    )
    records = F.transform("pairs", lambda p: p["record"]).alias("records")
    batch = int_div(F.col("_base"), size) + F.col("_batch")
    return grouped.join(base, BUCKET).select(batch.alias("batch_id"), "n", "first_key", "last_key", records)
