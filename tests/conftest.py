from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from sluicebox import Dataset, get_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = get_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__sql__maxMetadataStringLength="2000",
        spark__checkpoint__dir=str(shared),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


def at(seconds: float) -> datetime:
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def timed(spark, seconds):
    """``id, ts`` with one row per given second."""
    rows = [(i, at(s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "id bigint, ts timestamp_ntz")


def series_of(df, **changes) -> Dataset:
    settings = {"database": "db", "table": "t", "kind": "series", "time": "ts", "keys": ("id",), **changes}
    return Dataset(df, **settings)


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
