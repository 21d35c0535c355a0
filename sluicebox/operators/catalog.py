"""Which datasets there are, with a profile of each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.numbers import dataset_description, dataset_label
from sluicebox.functions.times import ms_text
from sluicebox.operators.filters import without_names
from sluicebox.sources.dataset import SERIES, Dataset
from sluicebox.tables import small_table

# Databases that are never listed, and the two dataset types.
SYSTEM_DATABASES = ("admin", "local", "config")
TYPE_NAMES = {"series": "InfluxDB", "collection": "MongoDB"}


def list_measurements(df: DataFrame, column: str = "_measurement") -> DataFrame:
    """The measurements of a bucket, sorted by name."""
    return df.select(F.col(column).alias("table_name")).distinct().orderBy("table_name")


def list_files(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """Tables below a folder: ``table_name, files, bytes``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    prefix = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    name = F.split(F.replace(below, F.lit(f"/{prefix}/"), F.lit("")), "/").getItem(0)
    listed = files.filter(F.endswith("path", F.lit(suffix))).select(
        F.regexp_replace(name, f"{suffix.replace('.', '[.]')}$", "").alias("table_name"), "length"
    )
    return listed.groupBy("table_name").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    )


def list_tables(spark: SparkSession, skip: Sequence[str] = SYSTEM_DATABASES) -> DataFrame:
    """``database_name, table_name`` of the session catalog, without system databases."""
    names = [
        (db.name, table.name)
        for db in spark.catalog.listDatabases()
        for table in spark.catalog.listTables(db.name)
        if not table.isTemporary
    ]
    listed = small_table(spark, names, {"database_name": "string", "table_name": "string"})
    return without_names(listed, "database_name", skip)


def dataset_entry(ds: Dataset) -> DataFrame:
    """One row: the descriptor of a dataset with its count and time range."""
    place = ("bucket", "measurement") if ds.kind == SERIES else ("database", "collection")
    database, table = F.lit(ds.database), F.lit(ds.table)
    first, last = (F.min(ds.time), F.max(ds.time)) if ds.time else (F.lit(None), F.lit(None))
    # The rows every other profile looks at: a record of a series has a time.
    profile = ds.selected().agg(
        F.count("*").alias("record_count"),
        first.cast("timestamp_ntz").alias("first_ts"),
        last.cast("timestamp_ntz").alias("last_ts"),
    )
    return profile.select(
        database.alias("database_name"),
        table.alias("table_name"),
        F.lit("").alias("tag_key"),
        F.lit("").alias("tag_value"),
        dataset_label(database, table).alias("dataset_name"),
        dataset_description(F.lit(ds.kind), database, table).alias("dataset_description"),
        F.lit(TYPE_NAMES[ds.kind]).alias("dataset_type"),
        F.create_map(F.lit(place[0]), database, F.lit(place[1]), table).alias("dataset_params"),
        "record_count",
        F.coalesce(ms_text(F.col("first_ts")), F.lit("")).alias("start_str"),
        F.coalesce(ms_text(F.col("last_ts")), F.lit("")).alias("end_str"),
    )


def dataset_listing(files: DataFrame, database: str, kinds: Mapping[str, str]) -> DataFrame:
    """Names only: one row per table of ``list_files``, without a look into any file.

    ``kinds`` tells which tables are series; the others are collections.
    """
    series = F.col("table_name").isin([name for name, kind in kinds.items() if kind == SERIES])
    kind = F.when(series, F.lit(SERIES)).otherwise(F.lit("collection"))
    database = F.lit(database)
    return files.select(
        database.alias("database_name"),
        "table_name",
        dataset_label(database, F.col("table_name")).alias("dataset_name"),
        dataset_description(kind, database, F.col("table_name")).alias("dataset_description"),
        F.when(series, TYPE_NAMES[SERIES]).otherwise(TYPE_NAMES["collection"]).alias("dataset_type"),
    )


def dataset_catalog(
    datasets: Sequence[Dataset], skip: Sequence[str] = SYSTEM_DATABASES
) -> DataFrame:
    """One row per dataset outside the system databases; skipped ones are not read."""
    kept = [ds for ds in datasets if ds.database not in skip]
    return union_all([dataset_entry(ds) for ds in kept])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("no datasets to list")
    return reduce(DataFrame.unionByName, frames)
