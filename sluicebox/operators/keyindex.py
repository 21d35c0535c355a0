"""Exact global order without sorting everything in one place.

A :class:`KeyIndex` holds cut points of a sort key and the exact number of rows
between them. The cut points come from a sample, so the buckets are about equal
whatever the distribution; the counts come from all rows, so every answer is
exact. The bucket of a row depends on its key alone, which makes the index safe
to use again in later jobs and after lost executors.

The index answers two kinds of question:

* the ordinal of every row (``with_ordinal``): one shuffle by bucket;
* the rows at a few given ordinals (``rows_in_buckets``): only the buckets that
  hold them are shuffled, which is how export ranges are cut.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicebox.functions.search import count_points_before
from sluicebox.functions.times import exact_literal, in_utc
from sluicebox.tables import small_table

ROWS_PER_BUCKET = 1_000_000
# Buckets that are worth having before there are that many rows: they cost nothing
# as literals, and the finer they are, the fewer rows a cut has to look at.
BASE_BUCKETS = 256
# Bounds the sample and every per-bucket table on the driver.
MAX_BUCKETS = 32_768
# Sampled keys per bucket.
OVERSAMPLE = 24
# Below this many rows a bucket is not worth a task of its own.
MIN_ROWS_PER_BUCKET = 2_000
# For looking up ordinals that lie far apart: buckets between two of them, and the least rows of one.
FINE_PER_ORDINAL, FINE_ROWS = 16, 500
SAMPLE_SEED = 2011
# Key ranges put into the scan filter at most; the nearest ones are merged beyond.
MAX_SCAN_RANGES = 64

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyIndex:
    keys: tuple[str, ...]
    points: tuple[tuple, ...]
    counts: tuple[int, ...]

    @property
    def cut_keys(self) -> tuple[str, ...]:
        """The first keys, as many as the cut points hold values for."""
        return self.keys[: len(self.points[0])] if self.points else ()

    @property
    def total(self) -> int:
        return sum(self.counts)

    @property
    def starts(self) -> list[int]:
        """Rows before each bucket."""
        return [0, *accumulate(self.counts)][:-1]

    def with_bucket(self, df: DataFrame, compiled: bool = False) -> DataFrame:
        """Add the bucket of each row; a row equal to a cut point opens its bucket.

        ``compiled`` is for a bucket that no filter looks at.
        """
        return count_points_before(df, self.cut_keys, self.points, BUCKET, inclusive=True, compiled=compiled)

    def tasks(self, df: DataFrame) -> int:
        """Tasks for a shuffle by bucket: as many as the rows need, whatever the session's own number."""
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(-(-self.total // ROWS_PER_BUCKET), min(least, len(self.counts)), 1)

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` with its bucket, dealt by ``keys`` and bucket to as many tasks as there is need for."""
        return self.with_bucket(df, compiled=True).repartition(self.tasks(df), *keys, BUCKET)

    def bases(self, df: DataFrame, column: str) -> DataFrame:
        """Bucket → rows before it; at most ``MAX_BUCKETS`` rows."""
        rows = list(enumerate(self.starts))
        return small_table(df.sparkSession, rows, {BUCKET: "int", column: "bigint"})

    def buckets_of(self, ordinals: Iterable[int]) -> list[int]:
        """The buckets that hold the given 0-based ordinals."""
        starts = self.starts
        found = {bisect_right(starts, o) - 1 for o in ordinals if 0 <= o < self.total}
        return sorted(found)

    def scan_filter(self, df: DataFrame, buckets: Sequence[int]) -> Column:
        """A condition on the first key alone that no row of ``buckets`` fails.

        It can be pushed into the scan, where the exact bucket cannot.
        """
        runs: list[list[int]] = []
        for b in sorted(buckets):
            if runs and runs[-1][1] == b - 1:
                runs[-1][1] = b
            else:
                runs.append([b, b])
        first = F.col(self.keys[0])
        dtype = df.schema[self.keys[0]].dataType
        if not self.points:
            return F.lit(True)
        runs = _merged(runs, MAX_SCAN_RANGES)
        condition = F.lit(False)
        for low, high in runs:
            part = F.lit(True)
            lower = self.points[low - 1][0] if low > 0 else None
            if lower is not None:
                part = part & (first >= exact_literal(lower).cast(dtype))
            if high < len(self.points):
                upper = self.points[high][0]
                part = part & (F.lit(False) if upper is None else first <= exact_literal(upper).cast(dtype))
            if lower is None:
                part = part | first.isNull()
            condition = condition | part
        return condition


def _merged(runs: list[list[int]], most: int) -> list[list[int]]:
    """At most ``most`` runs: the smallest gaps between them are closed."""
    if len(runs) <= most:
        return runs
    gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1], reverse=True)
    keep = set(gaps[: most - 1])
    out = [list(runs[0])]
    for i, run in enumerate(runs[1:], 1):
        if i in keep:
            out.append(list(run))
        else:
            out[-1][1] = run[1]
    return out


def build_index(
    df: DataFrame,
    keys: Sequence[str],
    *,
    rows: int | None = None,
    buckets: int | None = None,
) -> KeyIndex:
    """Sample the key, choose cut points and count the rows between them.

    Reads the key columns only, and of these only the first ones if they are
    enough to cut evenly. ``rows`` spares the count when it is known.
    """
    keys = tuple(keys)
    df = in_utc(df)
    if buckets is not None and buckets > MAX_BUCKETS:
        raise ValueError(f"{buckets} buckets; an index holds at most {MAX_BUCKETS}")
    if rows is None:
        rows = df.select(*keys).count()
    wanted = bucket_count(rows) if buckets is None else buckets
    points = _cut_points(df, keys, rows, wanted)
    if not points:
        return KeyIndex(keys, (), (rows,))
    index = KeyIndex(keys, points, ())
    placed = index.with_bucket(df.select(*index.cut_keys), compiled=True)
    counted = dict(placed.groupBy(BUCKET).count().collect())
    return KeyIndex(keys, points, tuple(counted.get(b, 0) for b in range(len(points) + 1)))


def cut_index(df: DataFrame, keys: Sequence[str], rows: int, buckets: int) -> KeyIndex:
    """The cut points alone, for a caller that counts in its own way; the index has no counts."""
    return KeyIndex(tuple(keys), _cut_points(in_utc(df), tuple(keys), rows, buckets), ())


def nulls_first(values: Sequence) -> tuple:
    """A sort key for rows of values, in Spark's ascending order."""
    return tuple((v is not None, v) for v in values)


def bucket_count(rows: int) -> int:
    by_size = -(-rows // ROWS_PER_BUCKET)
    small = min(BASE_BUCKETS, rows // MIN_ROWS_PER_BUCKET)
    return max(1, min(max(by_size, small), MAX_BUCKETS))


def fine_buckets(rows: int, apart: int) -> int:
    """Buckets for looking up ordinals that lie ``apart`` rows apart: a fraction of that each, where it pays."""
    wanted = FINE_PER_ORDINAL * rows // apart if apart > MIN_ROWS_PER_BUCKET else 0
    return max(1, min(max(bucket_count(rows), wanted), max(1, rows // FINE_ROWS), MAX_BUCKETS))


def _cut_points(
    df: DataFrame, keys: tuple[str, ...], rows: int, buckets: int
) -> tuple[tuple, ...]:
    """Cut points of about equal distance, on as few of the first keys as will do.

    A value that is a cut point twice is too frequent to be one bucket, so the
    next key is taken in to divide it. Null is a value like any other here.
    """
    if buckets <= 1 or rows == 0:
        return ()
    fraction = min(1.0, buckets * OVERSAMPLE / rows)
    picked: list[tuple] = []
    for width in range(1, len(keys) + 1):
        used = list(keys[:width])
        sampled = df.select(*used).sample(fraction, seed=SAMPLE_SEED)
        # At most MAX_BUCKETS * OVERSAMPLE keys, whose order in Python is that of Spark.
        sample = sorted((tuple(r) for r in sampled.collect()), key=nulls_first)
        if not sample:
            return ()
        picked = [sample[i * len(sample) // buckets] for i in range(1, buckets)]
        if len(set(picked)) == len(picked):
            break
    return tuple(dict.fromkeys(picked))


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    *,
    out: str = "rn",
    start: int = 1,
    index: KeyIndex | None = None,
) -> DataFrame:
    """Number all rows by ``keys``, which must be unique.

    Equal to ``row_number() over (order by keys)`` (plus ``start - 1``), with one
    shuffle by bucket instead of one task for everything.
    """
    df = in_utc(df)
    index = index or build_index(df, keys)
    base = f"{out}_base"
    placed = index.spread(df).join(F.broadcast(index.bases(df, base)), BUCKET)
    within = W.partitionBy(BUCKET).orderBy(*keys)
    numbered = placed.withColumn(out, F.col(base) + F.row_number().over(within) + F.lit(start - 1))
    return numbered.drop(BUCKET, base)


def rows_in_buckets(df: DataFrame, index: KeyIndex, buckets: Sequence[int]) -> DataFrame:
    """The rows of some buckets only, with their bucket."""
    if len(buckets) == len(index.counts):
        return index.with_bucket(df)
    near = df.filter(index.scan_filter(df, buckets))
    return index.with_bucket(near).filter(F.col(BUCKET).isin(list(buckets)))


def ranked_keys(
    df: DataFrame, index: KeyIndex, ordinals: Iterable[int], *, unique: bool = False
) -> DataFrame:
    """The distinct keys in the buckets that hold ``ordinals``, with ``rows_before`` and ``rows``.

    A key shared by many rows is counted before the shuffle, so it is one row
    per task and not a hot group. ``unique`` keys need no counting.
    """
    keys = list(index.keys)
    near = rows_in_buckets(in_utc(df.select(*keys)), index, index.buckets_of(ordinals))
    base = F.broadcast(index.bases(df, "bucket_start"))
    in_order = W.partitionBy(BUCKET).orderBy(*keys)
    if unique:
        before = F.col("bucket_start") + F.row_number().over(in_order) - 1
        return near.join(base, BUCKET).select(
            *keys, before.alias("rows_before"), F.lit(1).cast("bigint").alias("rows")
        )
    tied = near.groupBy(BUCKET, *keys).agg(F.count("*").alias("rows"))
    upto = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.col("bucket_start") + F.sum("rows").over(upto) - F.col("rows")
    return tied.join(base, BUCKET).select(*keys, before.alias("rows_before"), "rows")


def aligned_index(df: DataFrame, index: KeyIndex, multiple: int, buckets: int) -> KeyIndex:
    """An index of about ``buckets`` buckets that all but the last hold a multiple of ``multiple`` rows.

    Its cut points are whole keys, found in the few buckets of ``index`` that hold
    them; ``keys`` must be unique.
    """
    groups = -(-index.total // multiple)
    buckets = max(1, min(buckets, groups))
    starts = sorted({(k * groups // buckets) * multiple for k in range(1, buckets)} - {0})
    if not starts:
        return KeyIndex(index.keys, (), (index.total,))
    ranked = ranked_keys(df, index, starts, unique=True).filter(F.col("rows_before").isin(starts))
    # One row per bucket.
    found = {r["rows_before"]: tuple(r)[: len(index.keys)] for r in ranked.collect()}
    edges = [0, *starts, index.total]
    counts = tuple(b - a for a, b in zip(edges, edges[1:], strict=False))
    return KeyIndex(index.keys, tuple(found[s] for s in starts), counts)
