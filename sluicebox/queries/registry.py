"""The query table, and the test tables seen as datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.times import nano_text
from sluicebox.sources.dataset import Dataset, documents_of, read_collection, read_series

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PARTITIONS = 4
JOBS = 48
TOPIC = "ranges"
DATABASE = "warehouse"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE_SQL[fn.__name__] = oracle.strip()
        return fn

    return register


def events(spark: SparkSession, sf: str) -> Dataset:
    return read_series(
        spark,
        f"{sf}/events.parquet",
        database=DATABASE,
        table="events",
        time="ts",
        keys=["event_id"],
        series_keys=["event_type"],
        json_columns=["props"],
    )


def lineitem(spark: SparkSession, sf: str) -> Dataset:
    """A series with many equal times and no unique key."""
    return read_series(
        spark,
        f"{sf}/lineitem.parquet",
        database=DATABASE,
        table="lineitem",
        time="l_shipdate",
        series_keys=["l_returnflag"],
    )


def orders(spark: SparkSession, sf: str, hide_keys: bool = False) -> Dataset:
    return read_collection(
        spark,
        f"{sf}/orders.parquet",
        database=DATABASE,
        table="orders",
        keys=["o_orderkey"],
        time="o_orderdate",
        hide_keys=hide_keys,
    )


def event_documents(spark: SparkSession, sf: str) -> Dataset:
    """Events as documents whose keys differ from row to row."""
    kind = F.col("event_id") % 4
    time = nano_text(F.col("ts"))
    own = (
        F.when(kind == 0, F.concat(F.lit('"props": '), "props"))
        .when(kind == 1, F.concat(F.lit('"value": '), F.col("value").cast("string"), F.lit(', "user_id": '), "user_id"))
        .when(kind == 2, F.lit('"_source": "own", "note": null, "t": 17'))
        .otherwise(F.concat(F.lit('"tag": "'), "event_type", F.lit('", "deep": {"z": [1.50, 2e3, "1.0E5"], "a": "<x>"}')))
    )
    stamp = F.when(kind == 2, F.lit("")).otherwise(F.concat(F.lit(', "t": "'), time, F.lit('"')))
    text = F.concat(F.lit('{"_id": "e'), "event_id", F.lit('"'), stamp, F.lit(", "), own, F.lit("}"))
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.alias("doc"))
    return documents_of(df, database=DATABASE, table="mixed", document="doc", keys=["event_id"], time_member="t")


def documents(spark: SparkSession, sf: str) -> Dataset:
    return read_collection(
        spark,
        f"{sf}/documents.parquet",
        database=DATABASE,
        table="documents",
        keys=["doc_id"],
        hide_keys=True,
    )


def conversations(spark: SparkSession, sf: str) -> Dataset:
    return read_collection(
        spark,
        f"{sf}/conversations.parquet",
        database=DATABASE,
        table="conversations",
        keys=["conv_id", "turn"],
    )


# The tables and the unique key of each; lineitem has none.
TABLE_KEYS = {
    "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
    "customer": ["c_custkey"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "labels": ["doc_id"],
    "nation": ["n_nationkey"],
    "orders": ["o_orderkey"],
    "pages": ["page_id"],
    "part": ["p_partkey"],
    "region": ["r_regionkey"],
    "supplier": ["s_suppkey"],
}


def all_tables(spark: SparkSession, sf: str, databases: dict[str, str] | None = None) -> list[Dataset]:
    """All 14 tables; ``databases`` names the database of some of them."""
    databases = databases or {}
    found = [events(spark, sf), lineitem(spark, sf)]
    for table, keys in TABLE_KEYS.items():
        time = "o_orderdate" if table == "orders" else None
        found.append(
            read_collection(
                spark,
                f"{sf}/{table}.parquet",
                database=databases.get(table, DATABASE),
                table=table,
                keys=keys,
                time=time,
            )
        )
    return found
