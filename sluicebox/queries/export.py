"""Whole exports: offsets, audit, summary, collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators import collect, offsets
from sluicebox.plans.export import build_messages, export, plan_export
from sluicebox.plans.export import query_by_time as run_query_by_time
from sluicebox.queries.messages import DOCUMENT_MEMBERS, EVENT_MEMBERS, json_sql
from sluicebox.queries.profile import MS
from sluicebox.queries.registry import (
    DATABASE,
    JOBS,
    PARTITIONS,
    TOPIC,
    documents,
    events,
    lineitem,
    orders,
    query,
)
from sluicebox.session import scratch_dir
from sluicebox.sources.log import MessageLog

# Start offsets of a topic that was written to before: 100 messages per partition number.
STARTS = {p: 100 * p for p in range(PARTITIONS)}

EVENT_PLACES = f"""
    places as (
      select *, cast(job % {PARTITIONS} as integer) as part,
             row_number() over (partition by job % {PARTITIONS} order by ts, event_id) - 1 as pos
      from (select *, (rank() over (order by ts) - 1) // (select greatest(1, count(*) // {JOBS}) from events)
                     as job from events))
"""


def new_log(spark: SparkSession, purpose: str, partitions: int = PARTITIONS) -> MessageLog:
    return MessageLog(scratch_dir(spark, purpose), partitions)


@query(
    f"""
    with {EVENT_PLACES}
    select event_id, cast(job as integer) as job_id, part as "partition", 100 * part + pos as "offset"
    from places
    """
)
def topic_offsets(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    plan = plan_export(ds, PARTITIONS, jobs=JOBS)
    starts = offsets.offsets_frame(spark, STARTS)
    placed, _ = offsets.with_offsets(plan.assigned(), plan.index, starts)
    return placed.select("event_id", "job_id", "partition", "offset")


@query(
    f"""
    with r as (select *, row_number() over (order by ts, event_id) - 1 as o from events)
    select cast(o % {PARTITIONS} as integer) as "partition",
           100 * (o % {PARTITIONS}) + o // {PARTITIONS} as "offset", {json_sql(EVENT_MEMBERS)} as value
    from r
    """
)
def topic_offsets_by_row(spark: SparkSession, sf: str) -> DataFrame:
    plan = plan_export(events(spark, sf), PARTITIONS, jobs=JOBS)
    sent, _ = build_messages(plan, offsets.offsets_frame(spark, STARTS), strategy="row")
    return sent.select("partition", "offset", "value")


@query(
    f"""
    with {EVENT_PLACES}
    select part as "partition", pos as "offset", {json_sql(EVENT_MEMBERS)} as value from places
    """
)
def export_series(spark: SparkSession, sf: str) -> DataFrame:
    """The log itself, read back after an export."""
    log = new_log(spark, "export-series")
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    return _as_text(log.read(spark, TOPIC))


@query(
    f"""
    with t as (select *, ntile({JOBS}) over (order by doc_id) - 1 as job from documents)
    select cast(job % {PARTITIONS} as integer) as "partition",
           row_number() over (partition by job % {PARTITIONS} order by doc_id) - 1 as "offset",
           md5({json_sql(DOCUMENT_MEMBERS)}) as value_md5
    from t
    """
)
def export_collection(spark: SparkSession, sf: str) -> DataFrame:
    log = new_log(spark, "export-collection")
    export(documents(spark, sf), log, TOPIC, jobs=JOBS)
    read = _as_text(log.read(spark, TOPIC))
    return read.select("partition", "offset", F.md5("value").alias("value_md5"))


@query(
    f"""
    with p as (select count(*) as n, greatest(1, count(*) // {JOBS}) as rpj from lineitem),
         j as (select (rank() over (order by l_shipdate) - 1) // rpj as job from lineitem, p)
    select cast(job % {PARTITIONS} as integer) as "partition", count(*) as messages,
           cast(0 as bigint) as first_offset, count(*) - 1 as last_offset, count(*) as distinct_offsets
    from j group by job % {PARTITIONS}
    """
)
def export_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    """A series without a unique key still gets dense offsets."""
    log = new_log(spark, "export-ties")
    export(lineitem(spark, sf), log, TOPIC, jobs=JOBS)
    return log.read(spark, TOPIC).groupBy("partition").agg(
        F.count("*").alias("messages"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.countDistinct("offset").alias("distinct_offsets"),
    )


_GROWTH = f"""
    with {EVENT_PLACES},
         g as (select part, count(*) as n from places group by part)
"""


@query(
    _GROWTH
    + """
    select part as "partition", n as start_offset, 2 * n as end_offset, n as messages,
           part || ':' || n || ':' || (2 * n - 1) as offset_str
    from g
    """
)
def offset_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The second of two exports to the same topic."""
    log = new_log(spark, "offset-summary")
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    return export(events(spark, sf), log, TOPIC, jobs=JOBS).offsets


@query(
    _GROWTH
    + """
    select part as "partition", n as produced, n as offset_growth, true as matches from g
    """
)
def delivery_audit(spark: SparkSession, sf: str) -> DataFrame:
    log = new_log(spark, "delivery-audit")
    return export(events(spark, sf), log, TOPIC, jobs=JOBS).audit


def _summary(result) -> DataFrame:
    """The summary without the run's own clock and folder."""
    own = ("start_time_millis", "end_time_millis", "kafka_brokers_str")
    return result.summary.drop(*own).withColumn("offsets_data", F.concat_ws(" ", "offsets_data"))


@query(
    _GROWTH
    + f"""
    select strftime(min(ts), '{MS}') as query_start_str, strftime(max(ts), '{MS}') as query_end_str,
           '{DATABASE}' as database_str, 'events' as table_str, '' as tag_key_str, '' as tag_value_str,
           '{TOPIC}' as send_topic_str, count(*) as total_messages,
           (select string_agg(part || ':0:' || (n - 1), ' ' order by part) from g) as offsets_data
    from events
    """
)
def export_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = new_log(spark, "export-summary")
    return _summary(export(events(spark, sf), log, TOPIC, jobs=JOBS))


@query(
    f"""
    with w as (select * from orders
               where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '2000-01-01'
                 and o_orderstatus = 'O'),
         t as (select *, ntile({JOBS}) over (order by o_orderkey) - 1 as job from w),
         g as (select job % {PARTITIONS} as part, count(*) as n from t group by 1)
    select strftime(min(o_orderdate), '{MS}') as query_start_str,
           strftime(max(o_orderdate), '{MS}') as query_end_str,
           '{DATABASE}' as database_str, 'orders' as table_str,
           'o_orderstatus' as tag_key_str, 'O' as tag_value_str,
           '{TOPIC}' as send_topic_str, count(*) as total_messages,
           (select string_agg(part || ':0:' || (n - 1), ' ' order by part) from g) as offsets_data
    from w
    """
)
def query_by_time(spark: SparkSession, sf: str) -> DataFrame:
    log = new_log(spark, "query-by-time")
    result = run_query_by_time(
        orders(spark, sf),
        log,
        TOPIC,
        window=("1996-01-01T00:00:00Z", "2000-01-01T00:00:00Z"),
        tag=("o_orderstatus", "O"),
        jobs=JOBS,
    )
    return _summary(result)


@query(
    f"""
    with m as (select doc_id, cast(strlen({json_sql(DOCUMENT_MEMBERS)}) as bigint) as size from documents)
    select count(*) as record_num, arg_min(size, doc_id) as first_size,
           arg_min(size, doc_id) * count(*) as estimated_size, cast(sum(size) as bigint) as exact_size
    from m
    """
)
def collect_estimate(spark: SparkSession, sf: str) -> DataFrame:
    log = new_log(spark, "collect")
    export(documents(spark, sf), log, TOPIC, jobs=JOBS)
    return collect.collect_messages(log.read(spark, TOPIC))


@query(
    f"""
    with {EVENT_PLACES}
    select part as "partition", pos + (select count(*) from places q where q.part = p.part) as "offset",
           {json_sql(EVENT_MEMBERS)} as value
    from places p
    """
)
def collect_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of the second export alone, by its offsets."""
    log = new_log(spark, "collect-bounded")
    export(events(spark, sf), log, TOPIC, jobs=JOBS)
    second = export(events(spark, sf), log, TOPIC, jobs=JOBS).offsets
    start = second.select("partition", F.col("start_offset").alias("offset"))
    end = second.select("partition", F.col("end_offset").alias("offset"))
    return _as_text(collect.between_offsets(log.read(spark, TOPIC), start, end))


def _as_text(log: DataFrame) -> DataFrame:
    return log.select("partition", "offset", F.col("value").cast("string").alias("value"))


@query(
    f"""
    with {EVENT_PLACES}
    select part as "partition", count(*) as messages,
           count(*) filter (where event_id % 4 = 0) as plain, cast(0 as bigint) as rejected, true as matches
    from places group by part
    """
)
def export_keeps_plain_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text that is no JSON is sent as a string, and nothing is left out."""
    ds = events(spark, sf)
    props = F.when(F.col("event_id") % 4 == 0, F.lit("no json {")).otherwise(F.col("props"))
    log = new_log(spark, "plain-text")
    result = export(ds.with_df(ds.df.withColumn("props", props)), log, TOPIC, jobs=JOBS)
    done = result.accounting.first()
    sent = log.read(spark, TOPIC).withColumn("text", F.col("value").cast("string"))
    return sent.groupBy("partition").agg(
        F.count("*").alias("messages"),
        F.count(F.when(F.col("text").contains('"props":"no json {"'), 1)).alias("plain"),
        F.lit(done["rejected"]).cast("bigint").alias("rejected"),
        F.lit(done["matches"]).alias("matches"),
    )


@query(
    f"""
    with {EVENT_PLACES}
    select part as "partition", 'number not finite: value' as bad_reason, count(*) as n,
           (select count(*) from events) as planned,
           (select count(*) from events where event_id % 50 <> 0) as produced, true as matches
    from places where event_id % 50 = 0 group by part
    """
)
def export_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with NaN stay out, are kept with their reason, and the totals add up."""
    ds = events(spark, sf)
    value = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    result = export(ds.with_df(ds.df.withColumn("value", value)), new_log(spark, "rejects"), TOPIC, jobs=JOBS)
    done = result.accounting.first()
    return result.rejects.groupBy("partition", "bad_reason").agg(
        F.count("*").alias("n"),
        F.lit(done["planned"]).cast("bigint").alias("planned"),
        F.lit(done["produced"]).cast("bigint").alias("produced"),
        F.lit(done["matches"]).alias("matches"),
    )
