from __future__ import annotations

import json
import math
import random
import struct
import sys
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sluicebox.functions import numbers, times
from sluicebox.functions.jsontext import json_text, number_text, split_rejects
from sluicebox.operators.split import align_jobs

ALIGNED = [
    (48, 4, 48),
    (47, 4, 48),
    (48, 5, 50),
    (47, 5, 45),
    (47, 7, 49),
    (48, 100, 100),
    (47, 100, 100),
    (6, 4, 4),
    (0, 4, 0),
    (10, 0, 10),
    (100, 12, 96),
    (99, 12, 96),
]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("jobs, partitions, expected", ALIGNED)
def test_align_jobs(jobs, partitions, expected):
    assert align_jobs(jobs, partitions) == expected


def test_aligned_job_count_column(spark):
    df = spark.createDataFrame(ALIGNED, "j bigint, p bigint, expected bigint")
    got = df.select(numbers.aligned_job_count(F.col("j"), F.col("p")).alias("a"), "expected").collect()
    assert [r["a"] for r in got] == [r["expected"] for r in got]


def test_drop_last_lowers_the_request():
    assert align_jobs(46, 5, drop_last=True) == 45
    assert align_jobs(48, 4, drop_last=True) == 48


@given(st.integers(0, 500), st.integers(1, 200))
def test_aligned_is_a_multiple(jobs, partitions):
    aligned = align_jobs(jobs, partitions)
    assert aligned % partitions == 0
    assert jobs < partitions or abs(aligned - jobs) <= partitions / 2


def test_even_share(spark):
    for total, jobs in ((10, 3), (3, 5), (0, 4), (12, 4), (100, 7)):
        job = F.col("id")
        ranges = spark.range(jobs).select(
            numbers.even_share_start(job, total, jobs).alias("a"),
            numbers.even_share_start(job + 1, total, jobs).alias("b"),
        )
        pairs = [tuple(r) for r in ranges.collect()]
        assert pairs[0][0] == 0 and pairs[-1][1] == total
        sizes = [b - a for a, b in pairs]
        assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
        back = spark.range(total).select(numbers.even_share_job(F.col("id"), total, jobs).alias("j"))
        assert [r["j"] for r in back.collect()] == [k for k, n in enumerate(sizes) for _ in range(n)]


def test_offset_text(spark):
    assert value(spark, numbers.offset_text(F.lit(0), F.lit(100), F.lit(100))) == "0:100:99"


def test_first_nonempty_keeps_blanks(spark):
    assert value(spark, numbers.first_nonempty(F.lit(" mydb "), F.lit("x"))) == " mydb "
    assert value(spark, numbers.first_nonempty(F.lit(""), F.lit("x"))) == "x"
    assert value(spark, numbers.first_nonempty(F.lit(None).cast("string"), F.lit("x"))) == "x"


@pytest.mark.parametrize(
    "time, ms, nano",
    [
        (datetime(2024, 1, 1, 0, 0, 7, 179575), "2024-01-01T00:00:07.179Z", "2024-01-01T00:00:07.179575Z"),
        (datetime(2024, 1, 1), "2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00Z"),
        (datetime(2024, 1, 1, 10, 20, 30, 500000), "2024-01-01T10:20:30.500Z", "2024-01-01T10:20:30.5Z"),
        (datetime(1999, 12, 31, 23, 59, 59, 999999), "1999-12-31T23:59:59.999Z", "1999-12-31T23:59:59.999999Z"),
    ],
)
def test_time_texts(spark, time, ms, nano):
    ts = times.exact_literal(time)
    assert value(spark, times.ms_text(ts)) == ms
    assert value(spark, times.nano_text(ts)) == nano
    assert value(spark, times.parse_ms_text(F.lit(ms))) == time.replace(
        microsecond=time.microsecond // 1000 * 1000
    )


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    time = datetime(2024, 7, 1, 12, 0, 0, 179575)
    ts = times.exact_literal(time)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
        assert value(spark, ts) == time
        assert value(spark, times.epoch_millis(ts)) == 1719835200179
        assert value(spark, times.ms_text(ts)) == "2024-07-01T12:00:00.179Z"
        assert value(spark, times.nano_text(ts)) == "2024-07-01T12:00:00.179575Z"
        parsed = times.parse_ms_text(F.lit("2024-07-01T12:00:00.179Z"))
        assert value(spark, parsed) == time.replace(microsecond=179000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bad_time_text(spark):
    assert value(spark, times.parse_ms_text(F.lit("soon"), strict=False)) is None
    with pytest.raises(PySparkException):
        value(spark, times.parse_ms_text(F.lit("soon")))


def test_time_or_null(spark):
    assert value(spark, times.time_or_null(F.lit("17 apples"))) is None
    assert value(spark, times.time_or_null(F.lit("2024-01-01 00:00:01"))) == datetime(2024, 1, 1, 0, 0, 1)


@pytest.mark.parametrize("given_time", ["2024-01-05T06:00:00.5Z", "2024-01-05 06:00:00.500", datetime(2024, 1, 5, 6, 0, 0, 500000)])
def test_time_literal(spark, given_time):
    assert value(spark, times.time_literal(given_time)) == datetime(2024, 1, 5, 6, 0, 0, 500000)


def test_json_keeps_nulls_sorts_keys_and_writes_times(spark):
    schema = (
        "z int, a string, s struct<y: int, b: timestamp_ntz>, l array<struct<d: int, c: string>>, "
        "m map<string, int>, t timestamp_ntz"
    )
    when = datetime(2024, 1, 1, 0, 0, 0, 120000)
    rows = [
        (1, None, (2, when), [(1, "x"), (None, None)], {"q": 1, "b": None}, when),
        (None, "v", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    first, second = (r["v"] for r in df.select(json_text(df).alias("v")).collect())
    text = "2024-01-01T00:00:00.12Z"
    assert json.loads(first) == {
        "a": None,
        "l": [{"c": "x", "d": 1}, {"c": None, "d": None}],
        "m": {"b": None, "q": 1},
        "s": {"b": text, "y": 2},
        "t": text,
        "z": 1,
    }
    assert first.index('"a"') < first.index('"l"') < first.index('"m"') < first.index('"z"')
    assert first.index('"b":"2024') < first.index('"y"') and first.index('"b":null') < first.index('"q"')
    assert json.loads(second) == {"a": "v", "l": None, "m": None, "s": None, "t": None, "z": None}


def test_json_escapes(spark):
    df = spark.createDataFrame([("<a href='x'>&\u2028\u2029\"\\</a>",)], "t string")
    text = df.select(json_text(df).alias("v")).first()["v"]
    assert not set("<>&\u2028\u2029") & set(text)
    assert json.loads(text)["t"] == "<a href='x'>&\u2028\u2029\"\\</a>"


def test_rejects(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.0, [1.0], "{}"), (2, nan, [1.0], "{}"), (3, -inf, None, None), (4, None, [nan], None), (5, None, None, "{"), (6, 0.5, [], "[1]")]
    df = spark.createDataFrame(rows, "id int, x double, l array<double>, j string")
    good, bad = split_rejects(df, ["j"])
    assert [r["id"] for r in good.orderBy("id").collect()] == [1, 6]
    assert {r["id"]: r["bad_reason"] for r in bad.collect()} == {
        2: "number not finite: x",
        3: "number not finite: x",
        4: "number not finite: l",
        5: "malformed json: j",
    }


def test_rejects_in_structs_and_maps(spark):
    nan = float("nan")
    rows = [(1, (1.0, "a"), {"k": 1.0}), (2, (nan, "a"), None), (3, None, {"k": nan}), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, s struct<x: double, n: string>, m map<string, double>")
    good, bad = split_rejects(df)
    assert sorted(r["id"] for r in good.collect()) == [1, 4]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_number_text(spark):
    forms = {
        0.0: "0", 1.0: "1", -2.0: "-2", 0.5: "0.5", 123456.789: "123456.789", 1e7: "10000000", 12345678.25: "12345678.25",
        -1e7: "-10000000", 1e20: "100000000000000000000", 123456789012345680000.0: "123456789012345680000", 1e21: "1e+21",
        1.5e22: "1.5e+22", -1e300: "-1e+300", 0.001: "0.001", 0.0001: "0.0001", 0.00012345: "0.00012345", 1e-6: "0.000001",
        -2.5e-5: "-0.000025", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 3e-100: "3e-100",
    }
    df = spark.createDataFrame([(x,) for x in forms], "x double")
    got = {r["x"]: r["t"] for r in df.select("x", number_text(F.col("x")).alias("t")).collect()}
    assert got == forms
    small = spark.createDataFrame([(0.1,), (16777216.0,)], "x float").select(number_text(F.col("x")).alias("t"))
    assert [r["t"] for r in small.collect()] == ["0.1", "16777216"]


def test_numbers_inside_structures(spark):
    schema = "z string, d double, l array<double>, s struct<b:double,a:string>, m map<string,double>, e array<struct<q:float>>, a int"
    rows = [("<", 1.0, [1e7, None, 0.5], (2.0, 'x"y'), {"k": 3.0, "b\n": None}, [(4.0,)], 1), (None,) * 7, ("", None, [], (None, None), {}, [], None)]
    df = spark.createDataFrame(rows, schema)
    assert [r["v"] for r in df.select(json_text(df).alias("v")).collect()] == [
        '{"a":1,"d":1,"e":[{"q":4}],"l":[10000000,null,0.5],"m":{"b\\n":null,"k":3},"s":{"a":"x\\"y","b":2},"z":"\\u003c"}',
        '{"a":null,"d":null,"e":null,"l":null,"m":null,"s":null,"z":null}',
        '{"a":null,"d":null,"e":[],"l":[],"m":{},"s":{"a":null,"b":null},"z":""}',
    ]


def _encoded(x: float) -> str:
    """The shortest digits that read back, in full from 1e-6 to below 1e21, else with an exponent."""
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, rest = mantissa.partition(".")
    places = int(power or 0) - len(rest)
    digits = (whole + rest).lstrip("0")
    places += len(digits) - len(digits.rstrip("0"))
    digits = digits.rstrip("0") or "0"
    sign = "-" if math.copysign(1, x) < 0 else ""
    if x == 0:
        return sign + "0"
    first = len(digits) + places - 1
    if not 1e-6 <= abs(x) < 1e21:
        return f"{sign}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{first:+d}"
    if places >= 0:
        return sign + digits + "0" * places
    if first >= 0:
        return f"{sign}{digits[: first + 1]}.{digits[first + 1 :]}"
    return f"{sign}0.{'0' * (-first - 1)}{digits}"


def test_numbers_have_the_shortest_digits_that_read_back(spark):
    rng = random.Random(4)
    numbers = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(15_000)]
    numbers += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 24) for _ in range(20_000)]
    numbers += [float(rng.randint(10**15, 10**18)) for _ in range(5_000)] + [k * 0.1 for k in range(1_000)]
    numbers += [5e-324, 1e-323, 1.5e-323, 2.3e-310, 1e23, 2e-3, 1e22, 2.0**53 + 2, 2.0**63, sys.float_info.max]
    numbers += [0.0, -0.0, 1e21, 1e-7, 1e-6, 123456789012345680.0, -161304845894623140.0]
    numbers = [x for x in numbers if math.isfinite(x)]
    assert len(numbers) > 40_000
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, x double")
    got = df.select("i", number_text(F.col("x")).alias("t")).collect()
    assert [(r["t"], numbers[r["i"]]) for r in got if r["t"] != _encoded(numbers[r["i"]])] == []
