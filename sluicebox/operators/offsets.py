"""Offsets of messages within their partition, and what can be read off them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicebox.functions.numbers import offset_text
from sluicebox.operators.keyindex import BUCKET, KeyIndex
from sluicebox.tables import small_table

OFFSETS_SCHEMA = {"partition": "int", "offset": "bigint"}


def offsets_frame(spark: SparkSession, offsets: Mapping[int, int] | None) -> DataFrame:
    """``partition, offset`` from a map; one row per partition."""
    return small_table(spark, sorted((offsets or {}).items()), OFFSETS_SCHEMA)


def with_offsets(
    df: DataFrame,
    index: KeyIndex,
    start_offsets: DataFrame,
    out: str = "offset",
    reason: str | None = None,
    chunks: Sequence[tuple[int, int, int, int]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Number the rows of each ``partition`` in key order from its start offset.

    Returns the rows with ``out``, and ``partition, produced``. A partition is
    not one task: each (partition, bucket) chunk is counted first by a scan of
    the needed columns, which gives the chunk's first offset, and is then
    numbered on its own. Partitions must be made of key ranges (as by
    ``assign_jobs``), so that a bucket meets few of them and the chunk table
    stays at about buckets + jobs rows.

    ``chunks`` (``partition, bucket, sent, planned``) spare that scan where they are known.

    Rows with a value in the column ``reason`` are counted but not numbered and
    not returned; the second frame then also has ``planned, rejected``.
    """
    spark = df.sparkSession
    placed = index.with_bucket(df, compiled=True)
    good = F.lit(True) if reason is None else F.col(reason).isNull()
    if chunks is None:
        counted = placed.groupBy("partition", BUCKET)
        chunks = counted.agg(F.count(F.when(good, 1)).alias("n"), F.count("*").alias("planned")).collect()
    bases, produced, planned_of = [], {}, {}
    # Bounded, see above: one row per chunk and one per partition.
    starts = dict(start_offsets.select("partition", "offset").collect())
    for partition, bucket, n, planned in sorted(map(tuple, chunks)):
        if partition not in starts:
            raise ValueError(f"no start offset for partition {partition}")
        sent = produced.get(partition, 0)
        bases.append((partition, bucket, starts[partition] + sent))
        produced[partition] = sent + n
        planned_of[partition] = planned_of.get(partition, 0) + planned
    base = small_table(spark, bases, {"partition": "int", BUCKET: "int", "_base": "bigint"})
    within = W.partitionBy("partition", BUCKET).orderBy(*index.keys)
    if reason is not None:
        placed = placed.filter(good).drop(reason)
    dealt = placed.repartition(index.tasks(df), "partition", BUCKET)
    # Every chunk has a base. An inner join would have the rows' own places checked for nulls before the
    # shuffle, which writes the search for them out once more, in a method too long for the JVM to compile.
    numbered = dealt.join(F.broadcast(base), ["partition", BUCKET], "left").withColumn(
        out, F.col("_base") + F.row_number().over(within) - 1
    )
    if reason is not None:
        rows = [(p, planned_of[p], planned_of[p] - n, n) for p, n in sorted(produced.items())]
        kinds = {"partition": "int", "planned": "bigint", "rejected": "bigint", "produced": "bigint"}
        return numbered.drop(BUCKET, "_base"), small_table(spark, rows, kinds)
    made = small_table(spark, sorted(produced.items()), {"partition": "int", "produced": "bigint"})
    return numbered.drop(BUCKET, "_base"), made


def high_watermarks(log: DataFrame, partitions: int | Sequence[int]) -> DataFrame:
    """The next free offset of each partition; 0 where the log has nothing."""
    spark = log.sparkSession
    ids = list(range(partitions)) if isinstance(partitions, int) else list(partitions)
    known = small_table(spark, [(p,) for p in ids], {"partition": "int"})
    top = log.groupBy("partition").agg((F.max("offset") + 1).alias("high"))
    return known.join(top, "partition", "left").select(
        "partition", F.coalesce("high", F.lit(0)).cast("bigint").alias("offset")
    )


def offset_summary(start: DataFrame, end: DataFrame) -> DataFrame:
    """Growth of each partition known on both sides, with its ``p:first:last`` text."""
    first = start.select("partition", F.col("offset").alias("start_offset"))
    last = end.select("partition", F.col("offset").alias("end_offset"))
    both = first.join(last, "partition", "inner")
    return both.select(
        "partition",
        "start_offset",
        "end_offset",
        (F.col("end_offset") - F.col("start_offset")).alias("messages"),
        offset_text(F.col("partition"), F.col("start_offset"), F.col("end_offset")).alias("offset_str"),
    )


def delivery_audit(produced: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """Messages produced against offset growth, per partition."""
    growth = offset_summary(start, end).select("partition", F.col("messages").alias("offset_growth"))
    both = growth.join(produced, "partition", "full")
    made = F.coalesce("produced", F.lit(0)).cast("bigint")
    grown = F.coalesce("offset_growth", F.lit(0)).cast("bigint")
    agree = made == grown
    if "planned" in produced.columns:
        agree = agree & (F.coalesce("planned", F.lit(0)) == made + F.coalesce("rejected", F.lit(0)))
    return both.select("partition", made.alias("produced"), grown.alias("offset_growth"), agree.alias("matches"))


def messages_per_job(df: DataFrame) -> DataFrame:
    """``job_id, messages``."""
    return df.groupBy("job_id").agg(F.count("*").alias("messages"))


def messages_per_partition(df: DataFrame) -> DataFrame:
    """``partition, messages``."""
    return df.groupBy("partition").agg(F.count("*").alias("messages"))
