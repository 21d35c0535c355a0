"""Cutting a dataset into ranges, and giving each row its range and partition.

Only the plan is computed from the data: a handful of cut points. Rows then get
their job by a search among those points, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.numbers import (
    even_share_job,
    even_share_start,
    int_div,
    partition_of_job,
    partition_of_ordinal,
)
from sluicebox.functions.search import MAX_POINTS, count_points_before
from sluicebox.functions.times import cut_to_ms, exact_literal, in_utc
from sluicebox.operators.filters import in_window
from sluicebox.operators.keyindex import (
    BUCKET,
    MAX_BUCKETS,
    KeyIndex,
    build_index,
    fine_buckets,
    ranked_keys,
    rows_in_buckets,
    with_ordinal,
)
from sluicebox.tables import small_table

TIME_PLAN_COLUMNS = {"job_id": "int", "start_ts": "timestamp_ntz", "end_ts": "timestamp_ntz"}


def align_jobs(jobs: int, partitions: int, drop_last: bool = False) -> int:
    """The requested job count as a multiple of the partition count.

    The plain-number form of :func:`~sluicebox.functions.numbers.aligned_job_count`;
    ``drop_last`` first lowers the request by one.
    """
    jobs -= 1 if drop_last else 0
    over = jobs % partitions if partitions > 0 else 0
    if over == 0:
        return jobs
    lower = jobs - over
    return lower if 2 * over <= partitions <= lower else lower + partitions


@dataclass(frozen=True)
class TimePlan:
    """Jobs by time: job k ends at ``cuts[k]`` inclusive; rows after the last cut are the tail."""

    time: str
    cuts: tuple[datetime, ...]
    first: datetime | None
    last: datetime | None
    rows: int
    rows_per_job: int
    keep_tail: bool

    @property
    def has_tail(self) -> bool:
        return self.keep_tail and self.rows > 0 and (not self.cuts or self.last > self.cuts[-1])

    def ranges(self) -> list[tuple[int, datetime, datetime]]:
        ends = [*self.cuts, *([self.last] if self.has_tail else [])]
        starts = [self.first, *ends[:-1]]
        return [(k, s, e) for k, (s, e) in enumerate(zip(starts, ends))]

    def to_df(self, spark: SparkSession, partitions: int, topic: str) -> DataFrame:
        plan = small_table(spark, self.ranges(), TIME_PLAN_COLUMNS)
        return _with_target(plan, partitions, topic)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``job_id``: the number of cuts before the row's time."""
        points = [(c,) for c in self.cuts]
        timed = in_utc(df).filter(F.col(self.time).isNotNull())
        # Rows after the last cut are taken out by a filter on the job.
        placed = count_points_before(
            timed, [self.time], points, "job_id", inclusive=False, compiled=self.keep_tail
        )
        if not self.keep_tail:
            placed = placed.filter(F.col("job_id") < len(self.cuts))
        return placed


@dataclass(frozen=True)
class OrdinalPlan:
    """Jobs by ordinal: an even share of ``rows``; ``starts`` are the first keys of jobs 1, 2, …"""

    keys: tuple[str, ...]
    rows: int
    jobs: int
    starts: tuple[tuple, ...]

    def to_df(self, spark: SparkSession, partitions: int, topic: str) -> DataFrame:
        return _with_target(ordinal_ranges(spark, self.rows, self.jobs), partitions, topic)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``job_id``: the number of later jobs that start at or before the row."""
        return count_points_before(in_utc(df), self.keys, self.starts, "job_id", inclusive=True, compiled=True)


Plan = TimePlan | OrdinalPlan


@dataclass(frozen=True)
class TimeEnds:
    rows: int
    first: datetime | None
    last: datetime | None


def time_ends(df: DataFrame, time: str) -> TimeEnds:
    """Number of rows that have a time, and the first and last time: one aggregate."""
    return TimeEnds(*in_utc(df.select(time)).agg(F.count(time), F.min(time), F.max(time)).first())


def plan_by_time(
    df: DataFrame,
    time: str,
    jobs: int,
    *,
    total_mode: str = "full",
    keep_tail: bool = True,
    index: KeyIndex | None = None,
    ends: TimeEnds | None = None,
) -> TimePlan:
    """Cut at the time of every n-th row, n being the rows per job.

    Rows that share a cut time all go to the earlier job, so a job may be empty
    and keeps its number. ``total_mode="half_open"`` takes the rows per job from
    the count without the last record, ``keep_tail=False`` leaves out the rows
    after the last cut. An ``index`` on unique keys that begin with ``time``
    and the ``ends`` are used as they are if they are known.
    """
    _check_jobs(jobs)
    if total_mode not in ("full", "half_open"):
        raise ValueError(f"total_mode is full or half_open, not {total_mode}")
    df = in_utc(df).filter(F.col(time).isNotNull())
    ends = ends or time_ends(df, time)
    total = ends.rows
    if total_mode == "half_open" and total:
        start, stop = cut_to_ms(exact_literal(ends.first)), cut_to_ms(exact_literal(ends.last))
        total = in_window(df, time, start, stop).count()
    per_job = max(1, total // jobs)
    if ends.rows // per_job > MAX_POINTS:
        raise ValueError(f"{ends.rows // per_job} jobs; at most {MAX_POINTS} can be planned")
    unique = index is not None
    index = index or build_index(df, [time], rows=ends.rows)
    cuts = _cut_times(df, time, ends.rows, per_job, index, unique)
    return TimePlan(time, cuts, ends.first, ends.last, ends.rows, per_job, keep_tail)


def _cut_times(
    df: DataFrame, time: str, rows: int, per_job: int, index: KeyIndex, unique: bool
) -> tuple[datetime, ...]:
    ends = [k * per_job - 1 for k in range(1, rows // per_job + 1)]
    if not ends:
        return ()
    ranked = ranked_keys(df, index, ends, unique=unique)
    upto = F.col("rows_before") + F.col("rows")
    # A time shared by many rows can be the cut of several jobs.
    low, high = int_div(F.col("rows_before"), per_job) + 1, int_div(upto, per_job)
    hits = ranked.filter(high >= low).select(F.explode(F.sequence(low, high)).alias("k"), F.col(time))
    # One row per job at most, checked above against MAX_POINTS.
    cuts = dict(hits.collect())
    return tuple(cuts[k] for k in range(1, len(ends) + 1))


def plan_by_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    jobs: int,
    *,
    rows: int | None = None,
    index: KeyIndex | None = None,
) -> OrdinalPlan:
    """Share the rows out evenly in the order of ``keys``, which must be unique."""
    _check_jobs(jobs)
    if jobs > MAX_POINTS:
        raise ValueError(f"{jobs} jobs; at most {MAX_POINTS} can be planned")
    df = in_utc(df)
    index = index or build_index(df, keys, rows=rows)
    rows = index.total
    share, extra = divmod(rows, jobs)
    firsts = [k * share + min(k, extra) for k in range(1, jobs)]
    firsts = [o for o in firsts if 0 < o < rows]
    if not firsts:
        return OrdinalPlan(tuple(keys), rows, jobs, ())
    ranked = ranked_keys(df, index, firsts, unique=True)
    ordinal = F.col("rows_before")
    opens = (ordinal > 0) & (
        even_share_job(ordinal, rows, jobs) > even_share_job(F.greatest(ordinal - 1, F.lit(0)), rows, jobs)
    )
    # At most one row per job.
    found = ranked.filter(opens).select("rows_before", *keys).collect()
    starts = tuple(tuple(r)[1:] for r in sorted(found, key=lambda r: r["rows_before"]))
    return OrdinalPlan(tuple(keys), rows, jobs, starts)


def ordinal_ranges(spark: SparkSession, rows: int, jobs: int) -> DataFrame:
    """``job_id, start_offset, end_offset`` of an even share; nothing is read."""
    _check_jobs(jobs)
    job = F.col("id")
    return spark.range(jobs).select(
        job.cast("int").alias("job_id"),
        even_share_start(job, rows, jobs).alias("start_offset"),
        even_share_start(job + 1, rows, jobs).alias("end_offset"),
    )


def time_split_plan(
    df: DataFrame, time: str, jobs: int, partitions: int, topic: str, **options
) -> DataFrame:
    """``job_id, start_ts, end_ts, send_partition, send_topic`` of a split by time."""
    plan = plan_by_time(df, time, jobs, **options)
    return plan.to_df(df.sparkSession, partitions, topic)


def ordinal_split_plan(df: DataFrame, jobs: int, partitions: int, topic: str) -> DataFrame:
    """``job_id, start_offset, end_offset, send_partition, send_topic`` of a split by ordinal."""
    ranges = ordinal_ranges(df.sparkSession, df.count(), jobs)
    return _with_target(ranges, partitions, topic)


def assign_jobs(df: DataFrame, plan: Plan, partitions: int) -> DataFrame:
    """Add ``job_id`` and ``partition`` to each row that the plan's ranges hold."""
    _check_partitions(partitions)
    placed = plan.assign(df)
    return placed.withColumn("partition", partition_of_job(F.col("job_id"), partitions))


def round_robin(
    df: DataFrame, keys: Sequence[str], partitions: int, index: KeyIndex | None = None
) -> DataFrame:
    """Add ``partition``: rows in the order of ``keys`` go to the partitions in turn."""
    _check_partitions(partitions)
    numbered = with_ordinal(df, keys, out="_ordinal", start=0, index=index)
    return numbered.withColumn("partition", partition_of_ordinal(F.col("_ordinal"), partitions)).drop(
        "_ordinal"
    )


def every_nth(df: DataFrame, keys: Sequence[str], n: int, out: str = "rn") -> DataFrame:
    """Every n-th row in the order of ``keys``, with its 1-based number.

    Only the buckets that hold one are numbered. Buckets are chosen small beside
    ``n``, so that for a large ``n`` these are few; other rows are not shuffled.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    df = in_utc(df)
    index = build_index(df, keys, buckets=fine_buckets(df.select(*keys).count(), n))
    wanted = [k * n - 1 for k in range(1, index.total // n + 1)] if n > index.total // MAX_BUCKETS else None
    held = index.buckets_of(wanted) if wanted is not None else range(len(index.counts))
    if not held:
        return df.withColumn(out, F.lit(0).cast("bigint")).filter(F.lit(False))
    near = df if len(held) == len(index.counts) else rows_in_buckets(df, index, held).drop(BUCKET)
    return with_ordinal(near, keys, out=out, index=index).filter(F.col(out) % n == 0)


def ordinal_slice(
    df: DataFrame,
    keys: Sequence[str],
    start: int,
    stop: int,
    index: KeyIndex | None = None,
) -> DataFrame:
    """The rows with ``start <= ordinal < stop`` in the order of ``keys``, 0-based.

    Buckets inside the slice pass as they are; only those at its two ends are
    numbered.
    """
    df = in_utc(df)
    index = index or build_index(df, keys)
    start, stop = max(start, 0), min(stop, index.total)
    if start >= stop:
        return df.filter(F.lit(False))
    edges = index.buckets_of([start, stop - 1])
    low, high = edges[0], edges[-1]
    placed = index.with_bucket(df.filter(index.scan_filter(df, range(low, high + 1))))
    at_edge = placed.filter(F.col(BUCKET).isin(edges)).drop(BUCKET)
    ordinal = "_ordinal"
    numbered = with_ordinal(at_edge, keys, out=ordinal, start=0, index=index)
    kept = numbered.filter((F.col(ordinal) >= start) & (F.col(ordinal) < stop)).drop(ordinal)
    if high - low < 2:
        return kept
    inside = placed.filter((F.col(BUCKET) > low) & (F.col(BUCKET) < high)).drop(BUCKET)
    return inside.unionByName(kept)


def _with_target(plan: DataFrame, partitions: int, topic: str) -> DataFrame:
    _check_partitions(partitions)
    return plan.select(
        "*",
        partition_of_job(F.col("job_id"), partitions).alias("send_partition"),
        F.lit(topic).alias("send_topic"),
    )


def _check_jobs(jobs: int) -> None:
    if jobs < 1:
        raise ValueError("at least one job is needed")


def _check_partitions(partitions: int) -> None:
    if partitions < 1:
        raise ValueError("at least one partition is needed")
