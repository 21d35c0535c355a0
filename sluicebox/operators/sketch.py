"""Planning a series from two scans: a quantile sketch, then counts in buckets that are narrow at the cuts.

The first scan is one aggregate: total, ends, and a KLL sketch of the time, whose
parts merge before anything is shuffled. Its quantiles are the cut points of the
buckets; about every wanted ordinal there are two close together, so that the cut
lies between them all but surely. The second scan counts the rows of each bucket,
and of the narrow ones the rows of each time. That gives the cuts exactly, and the
number of messages of each chunk with them, so nothing has to be counted later on.

The sketch only decides where is looked closely. Where it was wrong, or a time is
too frequent to be one bucket, the caller is told to plan by the key index.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicebox.functions.numbers import int_div
from sluicebox.functions.search import count_points_before
from sluicebox.functions.times import in_utc
from sluicebox.operators.keyindex import BUCKET, MAX_BUCKETS, KeyIndex, bucket_count
from sluicebox.session import scratch_dir

#: Size of the sketch. Ranks it gives are off by more than ``RANK_ERROR`` of all rows once in a hundred times.
SKETCH_K, RANK_ERROR = 4096, 0.0008
#: Cuts up to which buckets are narrowed about each; with more, the narrow ones would be most of the table.
MAX_NARROW = 200

_EPOCH = datetime(1970, 1, 1)


def _micros(time: Column) -> Column:
    """A plain time as microseconds since 1970, as if it were UTC, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH.isoformat(sep=" ")).cast("timestamp_ntz"), time)


def _time(micros: int) -> datetime:
    return _EPOCH + timedelta(microseconds=micros)


@dataclass(frozen=True)
class TimeSketch:
    """Rows that have a time and rows that have none, the ends, and a sketch of how times are spread."""

    rows: int
    without_time: int
    first: datetime | None
    last: datetime | None
    sketch: bytes | None

    def quantiles(self, df: DataFrame, ranks: list[float]) -> list[datetime]:
        """About the times below which the given shares of the rows lie; no row is looked at."""
        if not ranks or self.sketch is None:
            return []
        one = df.sparkSession.range(1)
        found = one.select(
            F.kll_sketch_get_quantile_bigint(F.lit(bytearray(self.sketch)), F.array(*map(F.lit, ranks))).alias("q")
        )
        return [_time(v) for v in found.first()["q"]]


def time_sketch(df: DataFrame, time: str) -> TimeSketch:
    """Totals, ends and sketch of ``time``: one aggregate."""
    times = in_utc(df).select(time)
    rows, every, first, last, sketch = times.agg(
        F.count(time),
        F.count("*"),
        F.min(time),
        F.max(time),
        F.kll_sketch_agg_bigint(_micros(F.col(time)), F.lit(SKETCH_K)),
    ).first()
    return TimeSketch(rows, every - rows, first, last, bytes(sketch) if rows else None)


@dataclass(frozen=True)
class SketchedCuts:
    """Exact cuts, an index over the buckets they were found in, and ``(job, bucket, sent, planned)`` counts."""

    cuts: tuple[datetime, ...]
    index: KeyIndex
    chunks: tuple[tuple[int, int, int, int], ...]


def cuts_by_sketch(
    df: DataFrame, time: str, keys: tuple[str, ...], per_job: int, sketch: TimeSketch, good: Column
) -> SketchedCuts | None:
    """Cut at the time of every ``per_job``-th row; None where the sketch does not do.

    ``good`` tells which rows are counted as sent. ``keys`` begin with ``time``.
    """
    rows, wanted = sketch.rows, sketch.rows // per_job
    buckets = bucket_count(rows)
    if not wanted or wanted > MAX_NARROW or buckets + 2 * wanted > MAX_BUCKETS:
        return None
    even = sketch.quantiles(df, [i / buckets for i in range(1, buckets)])
    if len(set(even)) < len(even):
        # A time that is a cut point twice is too frequent to be one bucket.
        return None
    ends = [k * per_job for k in range(1, wanted + 1)]
    shares = [min(1.0, max(0.0, e / rows + side * RANK_ERROR)) for e in ends for side in (-1, 1)]
    about = sketch.quantiles(df, shares)
    # The upper of the two is a microsecond later, as a bucket begins with its point.
    brackets = [(low, high + timedelta(microseconds=1)) for low, high in zip(about[::2], about[1::2], strict=True)]
    points = sorted({*even, *[t for b in brackets for t in b]})
    narrow = [
        b for b in range(len(points) + 1) if any(b and points[b - 1] < high and points[b - 1] >= low for low, high in brackets)
    ]
    index = KeyIndex(keys, tuple((p,) for p in points), ())
    picked = in_utc(df).filter(F.col(time).isNotNull()).select(time, good.alias("good"))
    placed = index.with_bucket(picked, compiled=True)
    cell = F.when(F.col(BUCKET).isin(narrow), F.col(time))
    counted = placed.groupBy(BUCKET, cell.alias("t")).agg(
        F.count("*").alias("planned"), F.count(F.when(F.col("good"), 1)).alias("sent")
    )
    path = scratch_dir(df.sparkSession, "time-cells")
    counted.write.parquet(path)
    cells = df.sparkSession.read.schema(counted.schema).parquet(path)
    # One row per bucket.
    totals = {r[BUCKET]: r for r in cells.groupBy(BUCKET).agg(F.sum("planned").alias("planned"), F.sum("sent").alias("sent")).collect()}
    index = KeyIndex(keys, index.points, tuple(totals[b]["planned"] if b in totals else 0 for b in range(len(points) + 1)))
    upto = W.partitionBy(BUCKET).orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    base = F.broadcast(index.bases(cells, "bucket_start"))
    ranked = cells.filter(F.col("t").isNotNull()).join(base, BUCKET)
    ranked = ranked.withColumn("upto", F.col("bucket_start") + F.sum("planned").over(upto))
    # A time shared by many rows can be the cut of several jobs.
    low, high = int_div(F.col("upto") - F.col("planned"), per_job) + 1, int_div(F.col("upto"), per_job)
    hits = ranked.filter(high >= low).select(F.explode(F.sequence(low, high)).alias("k"), "t")
    found = dict(hits.collect())
    if any(k not in found for k in range(1, wanted + 1)):
        return None
    cuts = tuple(found[k] for k in range(1, wanted + 1))
    return SketchedCuts(cuts, index, _chunks(cells, cuts, index, totals, set(narrow)))


def _chunks(cells: DataFrame, cuts, index: KeyIndex, totals, narrow: set[int]) -> tuple[tuple[int, int, int, int], ...]:
    chunks = []
    for bucket, row in sorted(totals.items()):
        if bucket not in narrow:
            # No cut lies inside, so the whole bucket belongs to the job that its first time belongs to.
            job = bisect_left(cuts, index.points[bucket - 1][0]) if bucket else 0
            chunks.append((job, bucket, row["sent"], row["planned"]))
    near = count_points_before(
        cells.filter(F.col("t").isNotNull()), ["t"], [(c,) for c in cuts], "job", inclusive=False
    )
    # At most one row per narrow bucket and job.
    sums = near.groupBy("job", BUCKET).agg(F.sum("sent").alias("sent"), F.sum("planned").alias("planned"))
    return tuple(sorted([*chunks, *map(tuple, sums.collect())]))
