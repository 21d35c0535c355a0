"""Numbering and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators import batch, split
from sluicebox.operators.keyindex import build_index, with_ordinal
from sluicebox.operators.offsets import messages_per_job, messages_per_partition
from sluicebox.operators.series import series_boundaries, with_series_ordinal
from sluicebox.queries.registry import (
    JOBS,
    PARTITIONS,
    TOPIC,
    conversations,
    events,
    lineitem,
    orders,
    query,
)

BOUNDARY = 208
BATCH = 3


@query("select event_id, ts, row_number() over (order by ts, event_id) as rn from events")
def row_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    return with_ordinal(ds.df.select("event_id", "ts"), ds.order)


@query("select o_orderkey, o_custkey, row_number() over (order by o_orderkey) as rn from orders")
def row_ordinal_by_id(spark: SparkSession, sf: str) -> DataFrame:
    ds = orders(spark, sf)
    return with_ordinal(ds.df.select("o_orderkey", "o_custkey"), ds.order)


@query("select conv_id, turn, role, row_number() over (order by conv_id, turn) as rn from conversations")
def row_ordinal_compound(spark: SparkSession, sf: str) -> DataFrame:
    ds = conversations(spark, sf)
    return with_ordinal(ds.df.select("conv_id", "turn", "role"), ds.order)


@query(
    f"""
    select rn, event_id, ts as end_ts
    from (select event_id, ts, row_number() over (order by ts, event_id) as rn from events)
    where rn % {BOUNDARY} = 0
    """
)
def every_nth_boundary(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    hits = split.every_nth(ds.df.select("event_id", "ts"), ds.order, BOUNDARY)
    return hits.select("rn", "event_id", F.col("ts").alias("end_ts"))


_SERIES_ROWS = """
    select event_type, event_id, ts, row_number() over (partition by event_type order by ts, event_id) as rn
    from events
"""


@query(_SERIES_ROWS)
def per_series_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    narrow = ds.df.select("event_type", "event_id", "ts")
    return with_series_ordinal(narrow, ds.series_keys, ds.order)


@query(
    """
    select event_id, tag, row_number() over (partition by tag order by ts, event_id) as rn
    from (select *, case when event_type = 'purchase' then event_type end as tag from events)
    """
)
def per_series_ordinal_null_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Most records have no tag; together they are one series, spread over many buckets."""
    ds = events(spark, sf)
    tag = F.when(F.col("event_type") == "purchase", F.col("event_type")).alias("tag")
    return with_series_ordinal(ds.df.select(tag, "event_id", "ts"), ["tag"], ds.order).select("event_id", "tag", "rn")


@query("select event_id, row_number() over (order by ts, event_id) as rn from events")
def row_ordinal_fine(spark: SparkSession, sf: str) -> DataFrame:
    """More cut points than the root list holds, so both levels of the search are used."""
    ds = events(spark, sf)
    narrow = ds.df.select("event_id", "ts")
    index = build_index(narrow, ds.order, buckets=600)
    return with_ordinal(narrow, ds.order, index=index).select("event_id", "rn")


@query(
    f"""
    select event_type, rn // {BOUNDARY} - 1 as job_id,
           lag(ts) over (partition by event_type order by rn) as start_ts, ts as end_ts
    from ({_SERIES_ROWS}) where rn % {BOUNDARY} = 0
    """
)
def per_series_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    return series_boundaries(ds.df, ds.series_keys, ds.time, ds.order, BOUNDARY)


def _time_plan_sql(table: str, time: str, total: str, tail: bool) -> str:
    tail_row = f"union all select n // rpj, l from p where l > (select max(end_ts) from cuts)" if tail else ""
    return f"""
    with p as (select count(*) as n, min({time}) as f, max({time}) as l,
                      greatest(1, ({total}) // {JOBS}) as rpj from {table}),
         r as (select {time} as t, row_number() over (order by {time}) as rn from {table}),
         cuts as (select rn // rpj - 1 as job, t as end_ts from r, p where rn % rpj = 0),
         jobs as (select * from cuts {tail_row})
    select cast(job as integer) as job_id,
           coalesce(lag(end_ts) over (order by job), f) as start_ts, end_ts,
           cast(job % {PARTITIONS} as integer) as send_partition, '{TOPIC}' as send_topic
    from jobs, p
    """


@query(_time_plan_sql("events", "ts", "count(*)", True))
def time_split_plan(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    return split.time_split_plan(ds.df, ds.time, JOBS, PARTITIONS, TOPIC)


@query(_time_plan_sql("lineitem", "l_shipdate", "count(*)", True))
def time_split_plan_ties(spark: SparkSession, sf: str) -> DataFrame:
    ds = lineitem(spark, sf)
    return split.time_split_plan(ds.df, ds.time, JOBS, PARTITIONS, TOPIC)


@query(
    _time_plan_sql(
        "events",
        "ts",
        "select count(*) from events where ts < (select date_trunc('millisecond', max(ts)) from events)",
        False,
    )
)
def time_split_plan_half_open(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    return split.time_split_plan(
        ds.df, ds.time, JOBS, PARTITIONS, TOPIC, total_mode="half_open", keep_tail=False
    )


_TIME_ROWS = f"""
    with p as (select count(*) as n, greatest(1, count(*) // {JOBS}) as rpj from lineitem),
         r as (select l_shipdate, rank() over (order by l_shipdate) as rk from lineitem),
         j as (select (rk - 1) // rpj as job, n // rpj as full_jobs, l_shipdate from r, p)
"""


@query(
    _TIME_ROWS
    + f"""
    select cast(job as integer) as job_id, cast(job % {PARTITIONS} as integer) as "partition",
           job < max(full_jobs) as delivered, count(*) as messages,
           min(l_shipdate) as first_ts, max(l_shipdate) as last_ts
    from j group by job
    """
)
def time_split_rows(spark: SparkSession, sf: str) -> DataFrame:
    ds = lineitem(spark, sf)
    plan = split.plan_by_time(ds.df, ds.time, JOBS)
    placed = split.assign_jobs(ds.df, plan, PARTITIONS)
    return placed.groupBy("job_id", "partition").agg(
        (F.col("job_id") < len(plan.cuts)).alias("delivered"),
        F.count("*").alias("messages"),
        F.min(ds.time).alias("first_ts"),
        F.max(ds.time).alias("last_ts"),
    )


@query(
    _TIME_ROWS
    + """
    select cast(job as integer) as job_id, count(*) as messages from j where job < full_jobs group by job
    """
)
def time_split_delivered(spark: SparkSession, sf: str) -> DataFrame:
    ds = lineitem(spark, sf)
    plan = split.plan_by_time(ds.df, ds.time, JOBS, keep_tail=False)
    return messages_per_job(split.assign_jobs(ds.df, plan, PARTITIONS))


@query(
    f"""
    with r as (select row_number() over (order by o_orderkey) - 1 as o,
                      ntile({JOBS}) over (order by o_orderkey) - 1 as job from orders)
    select cast(job as integer) as job_id, min(o) as start_offset, max(o) + 1 as end_offset,
           cast(job % {PARTITIONS} as integer) as send_partition, '{TOPIC}' as send_topic
    from r group by job
    """
)
def ordinal_split_plan(spark: SparkSession, sf: str) -> DataFrame:
    jobs = split.align_jobs(JOBS, PARTITIONS, drop_last=True)
    return split.ordinal_split_plan(orders(spark, sf).df, jobs, PARTITIONS, TOPIC)


_TILES = "select *, ntile({jobs}) over (order by o_orderkey) - 1 as job from orders"


@query(
    f"""
    select o_orderkey, cast(job as integer) as job_id, cast(job % {PARTITIONS} as integer) as "partition"
    from ({_TILES.format(jobs=JOBS)})
    """
)
def partition_assignment(spark: SparkSession, sf: str) -> DataFrame:
    ds = orders(spark, sf)
    plan = split.plan_by_ordinal(ds.df, ds.order, JOBS)
    placed = split.assign_jobs(ds.df.select("o_orderkey"), plan, PARTITIONS)
    return placed.select("o_orderkey", "job_id", "partition")


@query(
    f"""
    select cast(job % 7 as integer) as "partition", count(*) as messages
    from ({_TILES.format(jobs=49)}) group by 1
    """
)
def partition_sizes(spark: SparkSession, sf: str) -> DataFrame:
    ds = orders(spark, sf)
    jobs = split.align_jobs(JOBS, 7, drop_last=True)
    plan = split.plan_by_ordinal(ds.df, ds.order, jobs)
    return messages_per_partition(split.assign_jobs(ds.df, plan, 7))


@query(
    f"""
    select event_id, cast((row_number() over (order by ts, event_id) - 1) % {PARTITIONS} as integer)
             as "partition"
    from events
    """
)
def row_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    dealt = split.round_robin(ds.df.select("event_id", "ts"), ds.order, PARTITIONS)
    return dealt.select("event_id", "partition")


# The slice: from a fifth to four fifths of the rows.
@query(
    """
    select o_orderkey, o_custkey, o_totalprice
    from (select *, row_number() over (order by o_orderkey) - 1 as o, count(*) over () as n from orders)
    where o >= n // 5 and o < 4 * n // 5
    """
)
def ordinal_slice(spark: SparkSession, sf: str) -> DataFrame:
    ds = orders(spark, sf)
    rows = ds.df.count()
    columns = ds.df.select("o_orderkey", "o_custkey", "o_totalprice")
    return split.ordinal_slice(columns, ds.order, rows // 5, 4 * rows // 5)


@query(
    f"""
    select batch_id, count(*) as n, min(event_id) filter (rn % {BATCH} = 0) as first_key,
           arg_max(event_id, rn) as last_key, string_agg(event_id || '/' || user_id, ',' order by rn) as records
    from (select *, rn // {BATCH} as batch_id
          from (select *, row_number() over (order by ts, event_id) - 1 as rn from events))
    group by batch_id
    """
)
def batch_records(spark: SparkSession, sf: str) -> DataFrame:
    ds = events(spark, sf)
    batches = batch.batch_records(ds.df, ds.order, BATCH, ["event_id", "user_id"])
    text = F.transform("records", lambda r: F.concat_ws("/", r["event_id"], r["user_id"]))
    return batches.select(
        "batch_id",
        "n",
        F.col("first_key.event_id").alias("first_key"),
        F.col("last_key.event_id").alias("last_key"),
        F.concat_ws(",", text).alias("records"),
    )


def _zoned_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose time is a zoned TIMESTAMP, as lakes and connectors give it."""
    return events(spark, sf).df.select("event_id", F.to_timestamp("ts").alias("ts"))


@query(_time_plan_sql("events", "ts", "count(*)", True))
def zoned_time_plan(spark: SparkSession, sf: str) -> DataFrame:
    return split.time_split_plan(_zoned_events(spark, sf), "ts", JOBS, PARTITIONS, TOPIC)


@query(
    """
    select event_id, ts
    from (select event_id, ts, row_number() over (order by ts, event_id) - 1 as o, count(*) over () as n from events)
    where o >= n // 5 and o < 4 * n // 5
    """
)
def zoned_slice(spark: SparkSession, sf: str) -> DataFrame:
    df = _zoned_events(spark, sf)
    n = df.count()
    return split.ordinal_slice(df, ["ts", "event_id"], n // 5, 4 * n // 5)
