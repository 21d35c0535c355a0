"""The message log read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.plans.export import export
from sluicebox.queries.export import EVENT_PLACES, new_log
from sluicebox.queries.messages import EVENT_MEMBERS, json_sql
from sluicebox.queries.registry import JOBS, TOPIC, events, query
from sluicebox.streaming import gaps, readers


@query(
    f"""
    with {EVENT_PLACES}
    select part as "partition", count(*) as messages, cast(sum(strlen({json_sql(EVENT_MEMBERS)})) as bigint)
             as bytes
    from places group by part
    """
)
def stream_running_counts(spark: SparkSession, sf: str) -> DataFrame:
    log = new_log(spark, "stream-counts")
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    sizes = readers.running_sizes(log.read_stream(spark, TOPIC))
    return readers.drain_counts(sizes, f"{log.root}-state", f"{log.root}-checkpoint")


_SECOND_RUN = f"""
    with {EVENT_PLACES}
    select part as "partition", pos + count(*) over (partition by part) as "offset",
           {json_sql(EVENT_MEMBERS)} as value
    from places
"""


@query(_SECOND_RUN)
def stream_from_end(spark: SparkSession, sf: str) -> DataFrame:
    """Start at the end offsets of the first export; only the second one is read."""
    log = new_log(spark, "stream-from-end")
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    ends = log.snapshot(spark, TOPIC).starts(log.partitions)
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    return _collected(log.read_stream(spark, TOPIC, starting=ends), log.root)


@query(
    f"""
    with {EVENT_PLACES}
    select part as "partition", pos as "offset", {json_sql(EVENT_MEMBERS)} as value from places
    """
)
def stream_collect_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Collect the first export up to its end offsets, with a second one in the log."""
    log = new_log(spark, "stream-bounded")
    first = export(events(spark, sf), log, TOPIC, jobs=JOBS).offsets
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    start = first.select("partition", F.col("start_offset").alias("offset"))
    end = first.select("partition", F.col("end_offset").alias("offset"))
    stream = readers.up_to_offsets(log.read_stream(spark, TOPIC), start, end)
    return _collected(stream, log.root)


@query(
    f"""
    with {EVENT_PLACES}
    select part as "partition", pos as "offset", {json_sql(EVENT_MEMBERS)} as value from places
    """
)
def stream_before_first_export(spark: SparkSession, sf: str) -> DataFrame:
    """The reader runs before anything was ever written, and gets all of the export afterwards."""
    log = new_log(spark, "stream-first")
    stream = log.read_stream(spark, TOPIC)
    _collected(stream, log.root)
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    return _collected(stream, log.root)


@query(_SECOND_RUN)
def log_between_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """The second export alone, by its offsets; files of the first are not opened."""
    log = new_log(spark, "between")
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    starts = log.snapshot(spark, TOPIC).starts(log.partitions)
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    found = log.read_between(spark, TOPIC, starts, "latest")
    return found.select("partition", "offset", F.col("value").cast("string").alias("value"))


# Of each thousand offsets one message is taken out of the copy and one put in twice.
LOST, DOUBLED = 7, 11


@query(
    f"""
    with {EVENT_PLACES}
    select part as "partition", case pos % 1000 when {LOST} then 'gap' else 'repeat' end as kind,
           pos as first_offset, pos + 1 as end_offset, cast(1 as bigint) as messages
    from places where pos % 1000 in ({LOST}, {DOUBLED})
    """
)
def stream_gap_report(spark: SparkSession, sf: str) -> DataFrame:
    """What a consumer of a damaged copy of an export finds missing and doubled."""
    log = new_log(spark, "stream-gaps")
    found = export(events(spark, sf), log, TOPIC, jobs=JOBS).offsets
    place = F.col("offset") % 1000
    times = F.when(place == LOST, 0).when(place == DOUBLED, 2).otherwise(1)
    copy = log.read(spark, TOPIC).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).drop("copy")
    copy.write.parquet(f"{log.root}-copy")
    stream = spark.readStream.schema(copy.schema).parquet(f"{log.root}-copy")
    start = found.select("partition", F.col("start_offset").alias("offset"))
    end = found.select("partition", F.col("end_offset").alias("offset"))
    return gaps.gaps_of_what_is_there(stream, start, end, f"{log.root}-seen", f"{log.root}-checkpoint")


def _collected(stream: DataFrame, root: str) -> DataFrame:
    messages = stream.select("partition", "offset", F.col("value").cast("string").alias("value"))
    return readers.drain_to_table(messages, f"{root}-collected", f"{root}-checkpoint")
