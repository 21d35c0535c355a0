"""A whole export: profile, split, serialize, number, write, audit.

Row data crosses one shuffle, the one that puts each chunk of a partition in
key order for its offsets. Everything before it reads only key columns.
"""

from __future__ import annotations

import time as clock
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.documents import document_reason
from sluicebox.functions.jsontext import reject_reason
from sluicebox.functions.numbers import int_div, partition_of_ordinal
from sluicebox.functions.times import exact_literal, ms_text
from sluicebox.operators.keyindex import BUCKET, KeyIndex, build_index, with_ordinal
from sluicebox.operators.messages import with_value
from sluicebox.operators.offsets import (
    delivery_audit,
    offset_summary,
    offsets_frame,
    with_offsets,
)
from sluicebox.operators.profile import Tag, TimeWindow
from sluicebox.operators.sketch import cuts_by_sketch, time_sketch
from sluicebox.operators.split import (
    Plan,
    TimeEnds,
    TimePlan,
    align_jobs,
    assign_jobs,
    plan_by_ordinal,
    plan_by_time,
    time_ends,
)
from sluicebox.sources.dataset import SERIES, Dataset
from sluicebox.sources.log import KafkaLog, MessageLog
from sluicebox.tables import small_table

JOBS = 48
# Names the export adds to a row on its way to the log.
ADDED = ("job_id", "partition", "offset", "bad_reason", BUCKET)

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("query_start_str", T.StringType()),
        T.StructField("query_end_str", T.StringType()),
        T.StructField("database_str", T.StringType()),
        T.StructField("table_str", T.StringType()),
        T.StructField("tag_key_str", T.StringType()),
        T.StructField("tag_value_str", T.StringType()),
        T.StructField("kafka_brokers_str", T.StringType()),
        T.StructField("send_topic_str", T.StringType()),
        T.StructField("total_messages", T.LongType()),
        T.StructField("start_time_millis", T.LongType()),
        T.StructField("end_time_millis", T.LongType()),
        T.StructField("offsets_data", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class ExportPlan:
    """The rows of an export with the ranges cut for them."""

    ds: Dataset
    rows: DataFrame
    index: KeyIndex
    ranges: Plan
    partitions: int
    #: ``partition, bucket, sent, planned`` where the planning has counted them, and what for.
    chunks: tuple[tuple[int, int, int, int], ...] | None = None
    nested: bool = False
    #: Records without a time that the selection would otherwise have, where the planning has seen them.
    without_time: int | None = None

    @property
    def jobs(self) -> int:
        if isinstance(self.ranges, TimePlan):
            return len(self.ranges.ranges())
        return self.ranges.jobs

    def to_df(self, topic: str) -> DataFrame:
        return self.ranges.to_df(self.rows.sparkSession, self.partitions, topic)

    def assigned(self) -> DataFrame:
        return assign_jobs(self.rows, self.ranges, self.partitions)


@dataclass(frozen=True)
class ExportResult:
    """What an export did: summary row, audit and accounting are small; ``rejects`` are the rows not sent.

    ``accounting`` is one row ``planned, produced, rejected, without_time,
    after_last_cut, matches``: every row the plan counted was either sent,
    rejected for a reason, or lies behind the last cut where that is wanted.
    """

    summary: DataFrame
    audit: DataFrame
    offsets: DataFrame
    run_id: str
    rejects: DataFrame
    accounting: DataFrame


def plan_export(
    ds: Dataset,
    partitions: int,
    *,
    jobs: int = JOBS,
    drop_last: bool = True,
    tag: Tag = None,
    window: TimeWindow = None,
    total_mode: str = "full",
    keep_tail: bool = True,
    nested: bool = False,
) -> ExportPlan:
    """Cut a dataset into ranges: a series by time, a collection by ordinal of its id.

    A series is planned by a sketch of its time if that will do, which reads it
    twice; else by its key index. ``nested`` is that of the messages to be made.
    """
    clash = sorted(set(ds.df.columns) & set(ADDED))
    if clash:
        raise ValueError(f"rename these columns before an export: {clash}")
    rows = ds.selected(tag, window)
    wanted = max(1, align_jobs(jobs, partitions, drop_last))
    if ds.kind == SERIES:
        # A window leaves out what has no time; without one the same scan counts it.
        sketch = time_sketch(rows if window is not None else ds.selected(tag, timeless=True), ds.time)
        without_time = None if window is not None else sketch.without_time
        per_job = max(1, sketch.rows // wanted)
        by_sketch = None
        if total_mode == "full":
            by_sketch = cuts_by_sketch(
                rows, ds.time, ds.order, per_job, sketch, _reason(ds, rows, nested).isNull()
            )
        if by_sketch is not None:
            cut = TimePlan(ds.time, by_sketch.cuts, sketch.first, sketch.last, sketch.rows, per_job, keep_tail)
            chunks = _by_partition(by_sketch.chunks, len(by_sketch.cuts), keep_tail, partitions)
            return ExportPlan(ds, rows, by_sketch.index, cut, partitions, chunks, nested, without_time)
        ends = TimeEnds(sketch.rows, sketch.first, sketch.last)
        index = build_index(rows, ds.order, rows=ends.rows)
        ranges = plan_by_time(
            rows,
            ds.time,
            wanted,
            total_mode=total_mode,
            keep_tail=keep_tail,
            index=index,
            ends=ends,
        )
        return ExportPlan(ds, rows, index, ranges, partitions, without_time=without_time)
    index = build_index(rows, ds.order)
    return ExportPlan(ds, rows, index, plan_by_ordinal(rows, ds.order, wanted, index=index), partitions)


def _by_partition(chunks, cuts: int, keep_tail: bool, partitions: int) -> tuple[tuple[int, int, int, int], ...]:
    """Counts per job and bucket as counts per partition and bucket."""
    sums: dict[tuple[int, int], list[int]] = {}
    for job, bucket, sent, planned in chunks:
        if job < cuts or keep_tail:
            own = sums.setdefault((job % partitions, bucket), [0, 0])
            own[0] += sent
            own[1] += planned
    return tuple((*key, *counts) for key, counts in sorted(sums.items()))


def build_messages(
    plan: ExportPlan,
    start_offsets: DataFrame,
    *,
    strategy: str = "job",
    nested: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Messages with their offsets, and ``partition, produced``.

    ``strategy="job"`` sends each range to one partition, ``"row"`` deals the
    rows out in turn. Rows that cannot be written as JSON are left out; see
    ``rejected_rows`` for them.
    """
    if strategy not in ("job", "row"):
        raise ValueError(f"strategy is job or row, not {strategy}")
    ds = plan.ds
    if strategy == "job":
        flagged = _flagged(plan, plan.assigned(), nested)
        chunks = plan.chunks if nested == plan.nested else None
        placed, produced = with_offsets(flagged, plan.index, start_offsets, reason="bad_reason", chunks=chunks)
    else:
        placed, produced = _dealt_out(plan, start_offsets, nested)
    return with_value(placed, ds, ["job_id", "partition", "offset"], nested), produced


def _flagged(plan: ExportPlan, rows: DataFrame, nested: bool) -> DataFrame:
    """``rows`` with ``bad_reason``. Text is always sendable as a string, so JSON is only checked if nested."""
    return rows.withColumn("bad_reason", _reason(plan.ds, rows, nested))


def _reason(ds: Dataset, rows: DataFrame, nested: bool) -> Column:
    if ds.document is not None:
        return document_reason(F.col(ds.document), ds.document)
    return reject_reason(rows, ds.json_columns if nested else (), ds.shown)


def rejected_rows(plan: ExportPlan, nested: bool = False) -> DataFrame:
    """The rows of a plan that cannot be messages, with job, partition and ``bad_reason``."""
    return _flagged(plan, plan.assigned(), nested).filter(F.col("bad_reason").isNotNull())


def _dealt_out(plan: ExportPlan, start_offsets: DataFrame, nested: bool) -> tuple[DataFrame, DataFrame]:
    """Row n goes to partition n mod p, where it is message n div p: no counting is needed."""
    sent = _flagged(plan, plan.ranges.assign(plan.rows), nested).filter("bad_reason is null").drop("bad_reason")
    # The index of the plan may count rejected rows, so the sent rows get their own counts.
    index = build_index(sent, plan.ds.order)
    ordinal = F.col("_ordinal")
    numbered = with_ordinal(sent, plan.ds.order, out="_ordinal", start=0, index=index)
    dealt = numbered.withColumn("partition", partition_of_ordinal(ordinal, plan.partitions))
    starts = F.broadcast(start_offsets.withColumnRenamed("offset", "_start"))
    offset = F.col("_start") + int_div(ordinal, plan.partitions)
    placed = dealt.join(starts, "partition").withColumn("offset", offset).drop("_start", "_ordinal")
    share, extra = divmod(index.total, plan.partitions)
    made = [(p, share + (p < extra)) for p in range(plan.partitions)]
    return placed, small_table(plan.rows.sparkSession, made, {"partition": "int", "produced": "bigint"})


def export(
    ds: Dataset,
    log: MessageLog,
    topic: str,
    *,
    jobs: int = JOBS,
    drop_last: bool = True,
    tag: Tag = None,
    window: TimeWindow = None,
    total_mode: str = "full",
    keep_tail: bool = True,
    strategy: str = "job",
    nested: bool = False,
    with_range: bool | None = None,
) -> ExportResult:
    """Send a dataset to a topic of a parquet message log.

    The summary of a series gives its time range; that of a collection leaves it
    empty, unless ``with_range`` asks for it (see :func:`query_by_time`). If another
    export to the topic is committed meanwhile, this one is refused
    (``ConcurrentWrite``) and none of its messages is visible.
    """
    spark = ds.df.sparkSession
    began = _millis()
    plan = plan_export(
        ds,
        log.partitions,
        jobs=jobs,
        drop_last=drop_last,
        tag=tag,
        window=window,
        total_mode=total_mode,
        keep_tail=keep_tail,
        nested=nested,
    )
    base = log.snapshot(spark, topic)
    before = offsets_frame(spark, base.starts(log.partitions))
    messages, produced = build_messages(plan, before, strategy=strategy, nested=nested)
    run_id = log.write(messages, topic, base=base)
    # As of this run's own version: later runs of others do not count.
    after = log.high_watermarks(spark, topic, base.version + 1)
    growth = offset_summary(before, after)
    audit = delivery_audit(produced, before, after)
    ended = _millis()
    wants_range = ds.kind == SERIES if with_range is None else with_range
    start_str, end_str = _range_text(plan, wants_range)
    lines = [r["offset_str"] for r in growth.orderBy("partition").collect()]
    total = produced.agg(F.sum("produced")).first()[0] or 0
    row = (
        start_str,
        end_str,
        ds.database,
        ds.table,
        str((tag or ("", ""))[0]),
        str((tag or ("", ""))[1]),
        log.root,
        topic,
        total,
        began,
        ended,
        lines,
    )
    rejects = rejected_rows(plan, nested)
    without_time = ds.without_time(tag) if plan.without_time is None else plan.without_time
    accounting = _accounting(plan, produced, total, rejects, without_time)
    summary = spark.createDataFrame([row], SUMMARY_SCHEMA)
    return ExportResult(summary, audit, growth, run_id, rejects, accounting)


def _accounting(
    plan: ExportPlan, produced: DataFrame, sent: int, rejects: DataFrame, without_time: int
) -> DataFrame:
    """One row that says what became of every row the plan counted."""
    if "rejected" in produced.columns:
        rejected, seen = produced.agg(F.sum("rejected"), F.sum("planned")).first()
        rejected, seen = rejected or 0, seen or 0
    else:
        rejected = rejects.count()
        seen = sent + rejected
    planned = plan.index.total
    behind = 0
    if isinstance(plan.ranges, TimePlan) and not plan.ranges.keep_tail:
        time, cuts = F.col(plan.ranges.time), plan.ranges.cuts
        behind = plan.rows.filter(time > exact_literal(cuts[-1])).count() if cuts else planned
    matches = planned == seen + behind and seen == sent + rejected
    kinds = dict.fromkeys(("planned", "produced", "rejected", "without_time", "after_last_cut"), "bigint")
    row = (planned, sent, rejected, without_time, behind, matches)
    return small_table(plan.rows.sparkSession, [row], {**kinds, "matches": "boolean"})


def query_by_time(
    ds: Dataset, log: MessageLog, topic: str, window: TimeWindow = None, **options
) -> ExportResult:
    """As :func:`export`, with the time range reported for collections too."""
    return export(ds, log, topic, window=window, with_range=True, **options)


def export_to_kafka(
    ds: Dataset, kafka: KafkaLog, topic: str, partitions: int, tasks: int | None = None, **options
) -> ExportPlan:
    """Send a dataset to a Kafka topic; the broker gives the offsets. Untested here.

    Rows are range-partitioned by partition and key, so that a task sends one
    stretch of one partition in order and a partition is spread over many tasks.
    """
    plan = plan_export(ds, partitions, **options)
    sent = _flagged(plan, plan.assigned(), nested=False).filter("bad_reason is null").drop("bad_reason")
    order: Sequence[str] = ["partition", *ds.order]
    spread = sent.repartitionByRange(tasks, *order) if tasks else sent.repartitionByRange(*order)
    in_order = spread.sortWithinPartitions(*order)
    kafka.write(with_value(in_order, ds, ["partition"]), topic)
    return plan


def _range_text(plan: ExportPlan, wanted: bool) -> tuple[str | None, str | None]:
    if not wanted or plan.ds.time is None:
        return "", ""
    if isinstance(plan.ranges, TimePlan):
        ends = TimeEnds(plan.ranges.rows, plan.ranges.first, plan.ranges.last)
    else:
        ends = time_ends(plan.rows, plan.ds.time)
    one = plan.rows.sparkSession.range(1)
    return tuple(one.select(*[ms_text(exact_literal(t)) for t in (ends.first, ends.last)]).first())


def _millis() -> int:
    return int(clock.time() * 1000)
