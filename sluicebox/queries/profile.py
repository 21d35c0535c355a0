"""Profiles: counts, ranges, first and last records, catalogue, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import numbers, times
from sluicebox.operators import catalog, filters, profile
from sluicebox.queries.registry import (
    DATABASE,
    all_tables,
    conversations,
    documents,
    event_documents,
    events,
    lineitem,
    orders,
    query,
)
from sluicebox.sources.dataset import SERIES, measurement_rows

MS = "%Y-%m-%dT%H:%M:%S.%gZ"
NANO = r"regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ'), '\.?0+Z$', 'Z')"


def _range_sql(table: str, time: str, where: str = "") -> str:
    return f"""
    select strftime(min({time}), '{MS}') as start_str, strftime(max({time}), '{MS}') as end_str
    from {table} {where}
    """


@query(_range_sql("events", "ts"))
def time_range(spark: SparkSession, sf: str) -> DataFrame:
    return profile.time_range(events(spark, sf))


@query(_range_sql("lineitem", "l_shipdate", "where l_returnflag = 'R'"))
def time_range_tagged(spark: SparkSession, sf: str) -> DataFrame:
    return profile.time_range(lineitem(spark, sf), tag=("l_returnflag", "R"))


@query(
    _range_sql(
        "orders",
        "o_orderdate",
        "where o_orderdate >= timestamp '1996-02-01' and o_orderdate < timestamp '1999-07-01'",
    )
)
def time_range_in_window(spark: SparkSession, sf: str) -> DataFrame:
    return profile.time_range(orders(spark, sf), window=("1996-02-01T00:00:00Z", "1999-07-01T00:00:00Z"))


@query("select count(*) as record_count, '' as start_str, '' as end_str from documents")
def time_range_without_time(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.dataset_entry(documents(spark, sf)).select("record_count", "start_str", "end_str")


@query(
    """
    select count(*) as record_count from events
    where ts >= timestamp '2024-01-05 06:00:00' and ts < timestamp '2024-01-25 18:30:00'
    """
)
def count_in_range(spark: SparkSession, sf: str) -> DataFrame:
    window = ("2024-01-05T06:00:00.000Z", "2024-01-25T18:30:00.000Z")
    return profile.record_count(events(spark, sf), window=window)


@query("select count(*) as record_count from orders where o_orderstatus = 'F'")
def count_tagged(spark: SparkSession, sf: str) -> DataFrame:
    return profile.record_count(orders(spark, sf), tag=("o_orderstatus", "F"))


@query("select count(*) as record_count from events where cast(user_id as varchar) = '17'")
def count_number_tag(spark: SparkSession, sf: str) -> DataFrame:
    return profile.record_count(events(spark, sf), tag=("user_id", "17"))


@query("select count(*) as record_count from conversations where turn = 1")
def count_typed_tag(spark: SparkSession, sf: str) -> DataFrame:
    return profile.record_count(conversations(spark, sf), tag=("turn", "1"))


@query(
    """
    select count(*) as record_count from events,
      (select date_trunc('millisecond', min(ts)) as a, date_trunc('millisecond', max(ts)) as b from events)
    where ts >= a and ts < b
    """
)
def count_half_open(spark: SparkSession, sf: str) -> DataFrame:
    return profile.half_open_count(events(spark, sf))


@query('select max(ts) as "time", count(*) as value from events')
def count_detail(spark: SparkSession, sf: str) -> DataFrame:
    return profile.count_detail(events(spark, sf))


@query(
    """
    select event_type, count(*) as record_count, min(ts) as first_ts, max(ts) as last_ts
    from events group by event_type
    """
)
def per_series_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.per_series_profile(events(spark, sf))


def _flat(detail: DataFrame) -> DataFrame:
    """The two array columns as text."""
    return detail.withColumns({"columns": F.concat_ws(",", "columns"), "data": F.to_json("data")})


@query(
    rf"""
    with ends as (
      select count(*) as n,
             arg_min(o, {{'t': o_orderdate, 'k': o_orderkey}}) as a,
             arg_max(o, {{'t': o_orderdate, 'k': o_orderkey}}) as b,
             min(o_orderdate) as first_ts, max(o_orderdate) as last_ts
      from (select o_orderdate, o_orderkey,
                   [cast(o_custkey as varchar), {NANO.format("o_orderdate")}, cast(o_orderkey as varchar),
                    o_orderpriority, o_orderstatus, cast(o_totalprice as varchar)] as o
            from orders))
    select {NANO.format("first_ts")} as "start", {NANO.format("last_ts")} as "end",
           'warehouse' as bucket, 'orders' as measurement, n as "count",
           'o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice' as columns,
           cast(to_json([a, b]) as varchar) as data
    from ends
    """
)
def dataset_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(profile.dataset_detail(orders(spark, sf)))


@query(
    rf"""
    with ends as (
      select count(*) as n, arg_min(e, k) as a, arg_max(e, k) as b,
             min(ts) as first_ts, max(ts) as last_ts
      from (select ts, {{'t': ts, 'i': event_id}} as k,
                   [cast(event_id as varchar), event_type, props, {NANO.format("ts")},
                    cast(user_id as varchar), cast(value as varchar)] as e
            from events where event_type = 'click'))
    select {NANO.format("first_ts")} as "start", {NANO.format("last_ts")} as "end",
           'warehouse' as bucket, 'events' as measurement, n as "count",
           'event_id,event_type,props,ts,user_id,value' as columns,
           cast(to_json([a, b]) as varchar) as data
    from ends
    """
)
def dataset_detail_tagged(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(profile.dataset_detail(events(spark, sf), tag=("event_type", "click")))


@query(
    """
    select '' as "start", '' as "end", 'warehouse' as bucket, 'documents' as measurement, n as "count",
           'lang,n_chars,source,text' as columns, cast(to_json([a, b]) as varchar) as data
    from (select count(*) as n, arg_min(d, doc_id) as a, arg_max(d, doc_id) as b
          from (select doc_id, [lang, cast(n_chars as varchar), source, text] as d from documents))
    """
)
def dataset_detail_without_time(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(profile.dataset_detail(documents(spark, sf)))


@query(
    f"""
    select cast(null as varchar) as "start", {NANO.format("max(ts) filter (event_id % 4 <> 2)")} as "end",
           'warehouse' as bucket, 'mixed' as measurement, count(*) as "count", '_source,note,t' as columns,
           cast(to_json([['own', null, '17'], [null, null, {NANO.format("max(ts) filter (event_id % 4 <> 2)")}]])
                as varchar) as data
    from events
    """
)
def schemaless_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a time come first, so the columns are theirs; the last document lacks most of them."""
    return _flat(profile.dataset_detail(event_documents(spark, sf)))


@query(
    f"""
    with e as (select min(ts) as a, max(ts) as b, count(*) as n from events
               where event_id % 4 = 3 and event_type = 'view')
    select {NANO.format("a")} as "start", {NANO.format("b")} as "end", 'warehouse' as bucket,
           'mixed' as measurement, n as "count", 'deep,t,tag' as columns,
           cast(to_json([['{{"a":"<x>","z":[1.5,2000,"1.0E5"]}}', {NANO.format("a")}, 'view'],
                         ['{{"a":"<x>","z":[1.5,2000,"1.0E5"]}}', {NANO.format("b")}, 'view']]) as varchar) as data
    from e
    """
)
def schemaless_detail_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """The tag is a member that other documents do not have."""
    return _flat(profile.dataset_detail(event_documents(spark, sf), tag=("tag", "view")))


@query(
    """
    (select 'first' as position, * from events order by ts, event_id limit 1)
    union all
    (select 'last' as position, * from events order by ts desc, event_id desc limit 1)
    """
)
def first_last_records(spark: SparkSession, sf: str) -> DataFrame:
    return profile.first_last_records(events(spark, sf))


@query(
    """
    select o_orderstatus, count(*) as record_count, min(o_orderkey) as first_key
    from orders where o_orderdate >= timestamp '1999-03-01' group by o_orderstatus
    """
)
def scan_from_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf).selected(window=("1999-03-01T00:00:00", None))
    return rows.groupBy("o_orderstatus").agg(
        F.count("*").alias("record_count"), F.min("o_orderkey").alias("first_key")
    )


@query("select distinct event_type as table_name from events")
def list_measurements(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_measurements(events(spark, sf).df, "event_type")


@query("select event_id, ts, user_id, value, props from events where event_type = 'purchase'")
def measurement_scan(spark: SparkSession, sf: str) -> DataFrame:
    return measurement_rows(events(spark, sf).df, "event_type", "purchase")


def _entry_sql(table: str, database: str, time: str | None, series: bool) -> str:
    kind = ("bucket", "measurement") if series else ("database", "collection")
    title = f"Measurement ''{table}'' in bucket ''{database}''"
    if not series:
        title = f"Collection ''{table}'' in database ''{database}''"
    first, last = ("''", "''")
    if time:
        first, last = (f"strftime({f}({time}), '{MS}')" for f in ("min", "max"))
    return f"""
    select '{database}' as database_name, '{table}' as table_name, '' as tag_key, '' as tag_value,
           '{database}:{table}' as dataset_name, '{title}' as dataset_description,
           '{"InfluxDB" if series else "MongoDB"}' as dataset_type,
           '{{"{kind[0]}":"{database}","{kind[1]}":"{table}"}}' as dataset_params,
           count(*) as record_count, {first} as start_str, {last} as end_str
    from {table}
    """


TIMES = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}
TABLES = [
    "benchmark",
    "conversations",
    "customer",
    "documents",
    "embeddings",
    "events",
    "labels",
    "lineitem",
    "nation",
    "orders",
    "pages",
    "part",
    "region",
    "supplier",
]
# Where the exclusion query puts some tables; two of the names are system databases.
PLACES = {"region": "admin", "nation": "config", "labels": "archive"}


def _catalog_sql(places: dict[str, str]) -> str:
    parts = []
    for table in TABLES:
        database = places.get(table, "warehouse")
        if database not in catalog.SYSTEM_DATABASES:
            series = table in ("events", "lineitem")
            parts.append(_entry_sql(table, database, TIMES.get(table), series))
    return " union all ".join(parts)


def _params_as_text(entries: DataFrame) -> DataFrame:
    return entries.withColumn("dataset_params", F.to_json("dataset_params"))


@query(_catalog_sql({}))
def dataset_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _params_as_text(catalog.dataset_catalog(all_tables(spark, sf)))


def _listing_sql() -> str:
    columns = "database_name, table_name, dataset_name, dataset_description, dataset_type"
    return f"select {columns} from ({_catalog_sql({})})"


@query(_listing_sql())
def dataset_listing(spark: SparkSession, sf: str) -> DataFrame:
    files = catalog.list_files(spark, sf)
    return catalog.dataset_listing(files, DATABASE, {"events": SERIES, "lineitem": SERIES})


@query(_catalog_sql(PLACES))
def catalog_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    listed = catalog.dataset_catalog(all_tables(spark, sf, PLACES), skip=())
    return _params_as_text(filters.without_names(listed, "database_name", catalog.SYSTEM_DATABASES))


@query(
    rf"""
    select event_id, strftime(ts, '{MS}') as ms_text, {NANO.format("ts")} as nano_text,
           epoch_us(ts) // 1000 as epoch_millis, date_trunc('millisecond', ts) as parsed,
           ts as from_nano, cast(null as timestamp) as from_type
    from events
    """
)
def time_text_forms(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return events(spark, sf).df.select(
        "event_id",
        times.ms_text(ts).alias("ms_text"),
        times.nano_text(ts).alias("nano_text"),
        times.epoch_millis(ts).alias("epoch_millis"),
        times.parse_ms_text(times.ms_text(ts)).alias("parsed"),
        times.time_or_null(F.regexp_replace(times.nano_text(ts), "Z$", "")).alias("from_nano"),
        times.time_or_null(F.col("event_type")).alias("from_type"),
    )


@query(
    """
    with o as (select user_id, count(*) as jobs from events group by user_id),
         p as (select user_id, jobs, n as partitions, jobs % n as r
               from o, (select unnest([4, 5, 7, 12, 100]) as n))
    select user_id, jobs, cast(partitions as bigint) as partitions,
           case when r = 0 then jobs
                when r <= partitions - r and jobs - r >= partitions then jobs - r
                else jobs + partitions - r end as aligned
    from p
    """
)
def aligned_job_counts(spark: SparkSession, sf: str) -> DataFrame:
    wanted = events(spark, sf).df.groupBy("user_id").agg(F.count("*").alias("jobs"))
    sizes = F.explode(F.array(*[F.lit(n).cast("bigint") for n in (4, 5, 7, 12, 100)]))
    pairs = wanted.select("user_id", "jobs", sizes.alias("partitions"))
    aligned = numbers.aligned_job_count(F.col("jobs"), F.col("partitions"))
    return pairs.withColumn("aligned", aligned)


@query(
    """
    select doc_id, coalesce(nullif(case when lang = 'en' then '' when lang = 'fr' then ' ' else lang end, ''),
                            source) as name,
           lang || ':' || source as label, 'Collection ''' || source || ''' in database ''' || lang || ''''
             as description,
           cast(strlen(text) as bigint) as bytes
    from documents
    """
)
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    preferred = F.when(lang == "en", "").when(lang == "fr", " ").otherwise(lang)
    return documents(spark, sf).df.select(
        "doc_id",
        numbers.first_nonempty(preferred, source).alias("name"),
        numbers.dataset_label(lang, source).alias("label"),
        numbers.dataset_description(F.lit("collection"), lang, source).alias("description"),
        numbers.byte_length(F.col("text")).alias("bytes"),
    )
