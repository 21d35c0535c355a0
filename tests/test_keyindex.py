from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluicebox import batch_records
from sluicebox.functions.search import MAX_POINTS, count_points_before
from sluicebox.operators import keyindex, series, split
from sluicebox.operators.keyindex import aligned_index, build_index, ranked_keys, with_ordinal
from sluicebox.operators.series import series_boundaries, with_series_ordinal
from sluicebox.operators.split import every_nth, ordinal_slice
from tests.conftest import plan_text, timed


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    """Many buckets even for small frames."""
    monkeypatch.setattr(keyindex, "MIN_ROWS_PER_BUCKET", 10)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("root", [255, 7, 3, 2])
@pytest.mark.parametrize("size", [0, 1, 2, 3, 8, 20, 49])
def test_search_equals_bisect(spark, size, root, inclusive):
    points = sorted(random.Random(size).choices(range(60), k=size))
    df = spark.range(-2, 64)
    got = count_points_before(df, ["id"], [(p,) for p in points], "n", inclusive=inclusive, root_points=root)
    find = bisect_right if inclusive else bisect_left
    assert {r["id"]: r["n"] for r in got.collect()} == {i: find(points, i) for i in range(-2, 64)}


@pytest.mark.parametrize("root", [255, 4])
def test_search_compound_keys(spark, root):
    rng = random.Random(5)
    rows = [(rng.choice("abcé日"), rng.randrange(9)) for _ in range(300)]
    points = sorted(set(rng.sample(rows, 30)))
    df = spark.createDataFrame(rows, "s string, n int")
    for inclusive, find in ((True, bisect_right), (False, bisect_left)):
        got = count_points_before(df, ["s", "n"], points, "at", inclusive=inclusive, root_points=root)
        assert all(r["at"] == find(points, (r["s"], r["n"])) for r in got.collect())


def test_search_null_keys_come_first(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 2), (0, 5)], "a int, b int")
    got = count_points_before(df, ["a", "b"], [(0, 9), (1, 1)], "at", inclusive=True)
    assert {(r["a"], r["b"]): r["at"] for r in got.collect()} == {(None, 1): 0, (1, None): 1, (1, 2): 2, (0, 5): 0}


@pytest.mark.parametrize(
    "kind, make",
    [
        ("string", lambda i: f"k{i:04d}"),
        ("date", lambda i: date.fromordinal(730_000 + i)),
        ("decimal(10,2)", lambda i: Decimal(i) / 4),
        ("double", lambda i: i / 7),
        ("binary", lambda i: bytes([i // 256 + 100, i % 256])),
    ],
)
def test_ordinals_for_other_key_types(spark, kind, make):
    keys = [make(i) for i in range(400)]
    df = spark.createDataFrame([(k,) for k in random.Random(3).sample(keys, 400)], f"k {kind}")
    assert len(build_index(df, ["k"]).counts) > 1
    got = with_ordinal(df, ["k"]).orderBy("rn").collect()
    values = [bytes(r["k"]) if kind == "binary" else r["k"] for r in got]
    assert values == keys and [r["rn"] for r in got] == list(range(1, 401))


def test_too_many_points(spark):
    with pytest.raises(ValueError, match="cut points"):
        count_points_before(spark.range(1), ["id"], [(0,)] * (MAX_POINTS + 1), "n", inclusive=True)


def test_index_counts_everything(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    index = build_index(df, ["k"])
    assert index.total == 5000 and len(index.counts) > 1
    assert max(index.counts) < 5000 / 2


def test_one_hot_value_is_one_ranked_row(spark):
    """A third of the rows share one key; it is counted before the shuffle."""
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 500).otherwise(F.col("id")).alias("k"))
    index = build_index(df, ["k"])
    ranked = {r["k"]: (r["rows_before"], r["rows"]) for r in ranked_keys(df, index, range(3000)).collect()}
    assert ranked[500] == (0, 1000)
    assert ranked[1000] == (1000, 1) and ranked[2999] == (2999, 1)


def test_only_the_needed_buckets_are_ranked(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    index = build_index(df, ["k"], buckets=40)
    ranked = ranked_keys(df, index, [1234], unique=True)
    found = {r["k"]: r["rows_before"] for r in ranked.collect()}
    assert found[1234] == 1234 and len(found) < 1000


def test_hot_prefix_is_spread_over_buckets(spark):
    """One first key for a third of the rows; the second key splits it."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    index = build_index(df, ["a", "b"])
    assert max(index.counts) < 6000 / 3
    got = with_ordinal(df, ["a", "b"], index=index).collect()
    expected = {row: n for n, row in enumerate(sorted((r["a"], r["b"]) for r in got), 1)}
    assert all(r["rn"] == expected[(r["a"], r["b"])] for r in got)


@pytest.mark.parametrize("rows", [0, 1, 5, 300])
def test_ordinals_of_few_rows(spark, rows):
    df = spark.range(rows).select((F.col("id") * 31 % 997).alias("k"))
    got = with_ordinal(df, ["k"]).orderBy("k").collect()
    assert [r["rn"] for r in got] == list(range(1, rows + 1))


def test_ordinals_with_null_keys(spark):
    rows = [(None, i) for i in range(50)] + [(i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = with_ordinal(df, ["a", "b"]).orderBy("rn").collect()
    assert [r["a"] for r in got] == [None] * 50 + list(range(100))
    assert [r["rn"] for r in got] == list(range(1, 151))


@pytest.mark.parametrize("start, stop", [(0, 0), (0, 1), (0, 500), (13, 14), (100, 399), (490, 900), (-5, 7), (30, 20)])
def test_slice_equals_sorted_list(spark, start, stop):
    keys = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(k, -k) for k in keys], "k int, v int")
    got = sorted(r["k"] for r in ordinal_slice(df, ["k"], start, stop).collect())
    assert got == sorted(keys)[max(start, 0) : max(stop, 0)]


def test_every_nth(spark):
    got = every_nth(spark.range(500).withColumnRenamed("id", "k"), ["k"], 7).orderBy("rn").collect()
    assert [(r["k"], r["rn"]) for r in got] == [(n - 1, n) for n in range(7, 501, 7)]
    with pytest.raises(ValueError):
        every_nth(spark.range(5), ["id"], 0)


def test_series_are_numbered_apart_though_one_is_hot(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", "zz"]), i * 37 % 2000) for i in range(2000)]
    df = spark.createDataFrame(rows, "s string, k int")
    index = build_index(df, ["s", "k"])
    assert max(index.counts) < 1000
    got = with_series_ordinal(df, ["s"], ["k"], index=index).collect()
    for name in ("hot", "a", "b", "zz"):
        mine = sorted(((r["k"], r["rn"]) for r in got if r["s"] == name))
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_series_boundaries(spark):
    from tests.conftest import at, timed

    df = timed(spark, range(100)).withColumn("s", F.col("id") % 2)
    got = series_boundaries(df, ["s"], "ts", ["ts", "id"], 20).orderBy("s", "job_id").collect()
    assert [tuple(r) for r in got] == [
        (0, 0, None, at(38)),
        (0, 1, at(38), at(78)),
        (1, 0, None, at(39)),
        (1, 1, at(39), at(79)),
    ]


def test_numbering_has_no_single_partition_step(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    plan = plan_text(with_ordinal(df, ["k"]))
    assert "SinglePartition" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_filter_on_a_searched_column_keeps_the_plan_small(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    index = build_index(df, ["k"], buckets=200)
    placed = index.with_bucket(df).filter(F.col(keyindex.BUCKET) < 50)
    assert len(plan_text(placed)) < 60_000


@pytest.mark.parametrize("root", [255, 3])
def test_search_among_points_with_nulls(spark, root):
    rng = random.Random(3)
    rows = [(rng.choice([None, None, None, 0, 4]), rng.choice([None, *range(6)])) for _ in range(200)]
    order = lambda r: keyindex.nulls_first(r)
    points = sorted(set(rows[:60]), key=order)[::2]
    df = spark.createDataFrame(rows, "a int, b int")
    for inclusive, find in ((True, bisect_right), (False, bisect_left)):
        got = count_points_before(df, ["a", "b"], points, "at", inclusive=inclusive, root_points=root)
        assert all(r["at"] == find(points, order((r["a"], r["b"])), key=order) for r in got.collect())


def test_null_tags_are_spread_like_any_value(spark):
    tag = F.when(F.col("id") % 5 == 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("tag")
    df = spark.range(4000).select(tag, F.col("id").alias("o")).repartition(4)
    index = build_index(df, ["tag", "o"], buckets=20)
    assert max(index.counts) <= 2 * 4000 / 20 and sum(index.counts) == 4000
    got = with_series_ordinal(df, ["tag"], ["o"], index=index).collect()
    expected = {}
    seen = {}
    for row in sorted(((r["tag"], r["o"]) for r in got), key=keyindex.nulls_first):
        seen[row[0]] = seen.get(row[0], 0) + 1
        expected[row] = seen[row[0]]
    assert {(r["tag"], r["o"]): r["rn"] for r in got} == expected and len(got) == 4000


def test_slices_of_a_frame_whose_key_is_mostly_null(spark):
    tag = F.when(F.col("id") % 5 == 0, F.col("id") % 3).alias("tag")
    df = spark.range(1000).select(tag, F.col("id").alias("o"))
    whole = sorted(((r["tag"], r["o"]) for r in df.collect()), key=keyindex.nulls_first)
    index = build_index(df, ["tag", "o"], buckets=15)
    for start, stop in ((0, 1000), (0, 3), (100, 700), (799, 801), (790, 1000)):
        got = ordinal_slice(df, ["tag", "o"], start, stop, index=index).collect()
        assert sorted(map(tuple, got), key=keyindex.nulls_first) == whole[start:stop]


def exchanges(df):
    return plan_text(df).count("Exchange hashpartitioning") + plan_text(df).count("Exchange rangepartitioning")


def test_batches_need_one_exchange(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), F.col("id").alias("v"))
    batches = batch_records(df, ["k"], 9, index=build_index(df, ["k"], buckets=16))
    assert exchanges(batches) == 1
    got = batches.orderBy("batch_id").collect()
    assert [r["batch_id"] for r in got] == list(range(556)) and got[-1]["n"] == 5
    assert [r["k"] for b in got for r in b["records"]] == list(range(5000))


@pytest.mark.parametrize(("rows", "size", "buckets"), [(1, 1, 4), (10, 3, 4), (10, 100, 4), (1000, 1, 8), (1000, 7, 1), (0, 5, 3)])
def test_aligned_buckets_hold_whole_batches(spark, rows, size, buckets):
    df = spark.range(rows).select(F.col("id").alias("k"))
    index = aligned_index(df, build_index(df, ["k"], buckets=5), size, buckets)
    assert index.total == rows and all(n % size == 0 for n in index.counts[:-1])
    assert len(index.counts) <= buckets and len(index.points) == len(index.counts) - 1


@pytest.mark.parametrize("n", [1, 3, 700, 2400, 9999, 10000, 10001])
def test_every_nth_at_any_distance(spark, n, monkeypatch):
    monkeypatch.setattr(keyindex, "MIN_ROWS_PER_BUCKET", 500)
    df = spark.range(10_000).select((F.col("id") * 77 % 10_000).alias("k"), F.lit("x").alias("v"))
    got = every_nth(df, ["k"], n).orderBy("rn").collect()
    assert [(r["k"], r["v"], r["rn"]) for r in got] == [(r - 1, "x", r) for r in range(n, 10_001, n)]


def test_only_buckets_with_a_boundary_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(keyindex, "MIN_ROWS_PER_BUCKET", 500)
    seen = []
    real = split.with_ordinal
    monkeypatch.setattr(split, "with_ordinal", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    assert every_nth(spark.range(40_000), ["id"], 10_000).count() == 4
    assert seen[0] < 5_000


@pytest.mark.parametrize("n", [2, 50, 600, 5000])
def test_boundaries_of_a_hot_series_and_of_small_ones(spark, monkeypatch, n):
    monkeypatch.setattr(keyindex, "MIN_ROWS_PER_BUCKET", 40)
    df = timed(spark, range(6000)).withColumn("s", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 6 == 0, None).otherwise(F.pmod("id", F.lit(40)).cast("string")))
    got = {(r["s"], r["job_id"]): (r["start_ts"], r["end_ts"]) for r in series_boundaries(df, ["s"], "ts", ["ts", "id"], n).collect()}
    want = {}
    by = {}
    for r in df.orderBy("ts").collect():
        by.setdefault(r["s"], []).append(r["ts"])
    for s, times in by.items():
        cuts = times[n - 1 :: n]
        want.update({(s, k): (cuts[k - 1] if k else None, t) for k, t in enumerate(cuts)})
    assert got == want


def test_pairs_beyond_the_broadcast(spark, monkeypatch):
    df = timed(spark, range(300)).withColumn("s", F.col("id") % 2)
    want = series_boundaries(df, ["s"], "ts", ["ts", "id"], 20).collect()
    monkeypatch.setattr(series, "BROADCAST_PAIRS", 0)
    assert sorted(series_boundaries(df, ["s"], "ts", ["ts", "id"], 20).collect()) == sorted(want)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 255, 1000, 1023, 1024, 2000])
def test_trees_find_what_the_fold_finds(spark, n, inclusive):
    rng = random.Random(n)
    points = sorted({(rng.randrange(5 * n),) for _ in range(n)})
    values = [rng.randrange(-2, 5 * n + 2) for _ in range(200)] + [p for p, in points[:50]] + [None]
    df = spark.createDataFrame([(v,) for v in values], "k int")
    got = count_points_before(df, ["k"], points, "b", inclusive=inclusive, compiled=True).collect()
    find = bisect_right if inclusive else bisect_left
    flat = [p for p, in points]
    assert [r["b"] for r in got] == [0 if v is None else find(flat, v) for v in values]


@pytest.mark.parametrize("n", [1, 7, 40, 63, 200])
def test_trees_over_two_keys(spark, n):
    rng = random.Random(n)
    points = sorted({(rng.randrange(9), rng.randrange(40)) for _ in range(n)})
    values = [(rng.randrange(-1, 10), rng.randrange(-1, 41)) for _ in range(300)] + points
    df = spark.createDataFrame(values, "a int, b int")
    got = count_points_before(df, ["a", "b"], points, "n", inclusive=True, compiled=True).collect()
    assert [r["n"] for r in got] == [bisect_right(points, v) for v in values]
