"""Numbering and cutting each series on its own.

A series may hold a large part of all rows, so it is not one window group. The
index is built on (series, order), which spreads a big series over buckets; the
rows of a series in earlier buckets are then added to the number within the
bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicebox.functions.numbers import int_div
from sluicebox.functions.search import ROOT_POINTS
from sluicebox.functions.times import in_utc
from sluicebox.operators.keyindex import (
    BUCKET,
    KeyIndex,
    bucket_count,
    build_index,
    cut_index,
    fine_buckets,
    nulls_first,
)
from sluicebox.session import scratch_dir

#: Pairs of series and bucket that are broadcast at most; more are joined by a shuffle.
BROADCAST_PAIRS = 200_000


def with_series_ordinal(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    *,
    out: str = "rn",
    index: KeyIndex | None = None,
) -> DataFrame:
    """Number the rows of each series from 1 by ``order``, which must be unique in it.

    Equal to ``row_number() over (partition by series order by order)``.
    """
    series, order = list(series), list(order)
    df = in_utc(df)
    index = index or build_index(df, [*series, *order])
    placed = index.spread(df, *series)
    within = W.partitionBy(BUCKET, *series).orderBy(*order)
    numbered = placed.withColumn(out, F.row_number().over(within).cast("bigint"))
    if len(index.cut_keys) <= len(series):
        # No cut falls into a series, so none goes on into another bucket.
        return numbered.drop(BUCKET)
    carried = F.broadcast(_carried(df, series, index))
    same = [numbered[BUCKET] == carried["_in"]]
    same += [numbered[name].eqNullSafe(carried[f"_s{i}"]) for i, name in enumerate(series)]
    total = F.col(out) + F.coalesce(F.col("_carry"), F.lit(0))
    return numbered.join(carried, same, "left").withColumn(out, total).select(*df.columns, out)


def _carried(df: DataFrame, series: list[str], index: KeyIndex) -> DataFrame:
    """Bucket and series → rows of the series in earlier buckets, where there are any.

    Only a series that a cut point falls into can go on from one bucket to the
    next. There are no more of these than cut points, and all their buckets
    together are at most twice as many.
    """
    cut_series = sorted({point[: len(series)] for point in index.points}, key=nulls_first)
    schema = ", ".join(f"_s{i} {df.schema[s].dataType.simpleString()}" for i, s in enumerate(series))
    cut = F.broadcast(df.sparkSession.createDataFrame(cut_series, schema))
    same = [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(series)]
    spread = index.with_bucket(df.select(*index.cut_keys).join(cut, same))
    names = [f"_s{i}" for i in range(len(series))]
    counts = spread.groupBy(BUCKET, *names).agg(F.count("*").alias("n"))
    earlier = W.partitionBy(*names).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carry = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return counts.select(F.col(BUCKET).alias("_in"), *names, carry.alias("_carry")).filter("_carry > 0")


def series_boundaries(
    df: DataFrame, series: Sequence[str], time: str, order: Sequence[str], n: int
) -> DataFrame:
    """The time of every n-th row of each series: ``series, job_id, start_ts, end_ts``.

    ``start_ts`` is the previous boundary, null for the first one. Rows are counted
    by series and bucket; only where a boundary lies are they looked at and numbered.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    series, order = list(series), list(order)
    narrow = in_utc(df.select(*dict.fromkeys([*series, time, *order])))
    rows = narrow.count()
    # More points than go into one list would cost the search more than they save.
    fine = fine_buckets(rows, n)
    index = cut_index(narrow, [*series, *order], rows, fine if fine <= ROOT_POINTS else bucket_count(rows))
    near = _rows_at_boundaries(narrow, series, index, n)
    within = W.partitionBy(BUCKET, *[f"_s{i}" for i in range(len(series))]).orderBy(*order)
    numbered = near.withColumn("rn", F.col("_before") + F.row_number().over(within))
    job = int_div(F.col("rn"), n) - 1
    hits = numbered.filter(F.col("rn") % n == 0).select(*series, job.alias("job_id"), F.col(time).alias("t"))
    # A boundary ends its own job and starts the next one; bringing the two
    # together by job equals lag() by series, without a window group per series.
    none = F.lit(None).cast("timestamp_ntz")
    sides = F.array(
        F.struct(F.col("job_id"), none.alias("start_ts"), F.col("t").alias("end_ts")),
        F.struct((F.col("job_id") + 1).alias("job_id"), F.col("t").alias("start_ts"), none.alias("end_ts")),
    )
    halves = hits.select(*series, F.explode(sides).alias("side")).select(*series, "side.*")
    jobs = halves.groupBy(*series, "job_id").agg(
        F.max("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")
    )
    return jobs.filter(F.col("end_ts").isNotNull())


def _rows_at_boundaries(df: DataFrame, series: list[str], index: KeyIndex, n: int) -> DataFrame:
    """The rows of the (series, bucket) pairs that hold an n-th row of the series, with the rows ``_before`` them.

    Buckets are ranges of (series, order), so there are no more pairs than series
    and buckets together.
    """
    names = [f"_s{i}" for i in range(len(series))]
    placed = index.with_bucket(df, compiled=True).withColumns({name: F.col(s) for name, s in zip(names, series, strict=True)})
    pairs = placed.groupBy(BUCKET, *names).agg(F.count("*").alias("n"))
    upto = W.partitionBy(*names).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = pairs.withColumn("upto", F.sum("n").over(upto)).withColumn("_before", F.col("upto") - F.col("n"))
    holds = int_div(F.col("upto"), n) > int_div(F.col("_before"), n)
    counted = ends.filter(holds).select(F.col(BUCKET).alias("_in"), *[F.col(c).alias(f"{c}_in") for c in names], "_before")
    path = scratch_dir(df.sparkSession, "series-counts")
    counted.write.parquet(path)
    wanted = df.sparkSession.read.schema(counted.schema).parquet(path)
    same = (placed[BUCKET] == wanted["_in"]) & reduce(
        and_, [placed[c].eqNullSafe(wanted[f"{c}_in"]) for c in names], F.lit(True)
    )
    few = wanted.count() <= BROADCAST_PAIRS
    return placed.join(F.broadcast(wanted) if few else wanted, same).drop("_in", *[f"{c}_in" for c in names])
