"""What was collected from a topic: number of messages and their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.numbers import byte_length


def between_offsets(log: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """Messages from the start offset of their partition up to its end offset, exclusive.

    Both are ``partition, offset`` frames with one row per partition.
    """
    first = start.select("partition", F.col("offset").alias("_first"))
    stop = end.select("partition", F.col("offset").alias("_stop"))
    bounds = F.broadcast(first.join(stop, "partition"))
    inside = (F.col("offset") >= F.col("_first")) & (F.col("offset") < F.col("_stop"))
    return log.join(bounds, "partition").filter(inside).drop("_first", "_stop")


def collect_messages(log: DataFrame) -> DataFrame:
    """One row: ``record_num, first_size, estimated_size, exact_size`` in bytes.

    The estimate is the size of the first message, by partition and offset,
    times the number of messages.
    """
    size = byte_length(F.col("value"))
    sizes = log.select("partition", "offset", size.alias("size"))
    total = sizes.agg(
        F.count("*").alias("record_num"),
        F.min_by("size", F.struct("partition", "offset")).alias("first_size"),
        F.sum("size").alias("exact_size"),
    )
    return total.select(
        "record_num",
        F.coalesce("first_size", F.lit(0)).alias("first_size"),
        (F.coalesce("first_size", F.lit(0)) * F.col("record_num")).alias("estimated_size"),
        F.coalesce("exact_size", F.lit(0)).alias("exact_size"),
    )
