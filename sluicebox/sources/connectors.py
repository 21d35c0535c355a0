"""Reading datasets out of stores through public Spark connectors.

These only set reader options; the connector has to be on the class path. None
is present in the test environment, so they are untested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def mongo_collection(spark: SparkSession, uri: str, database: str, collection: str, **options: str) -> DataFrame:
    """A collection through the MongoDB Spark connector; filters are pushed into the store."""
    names = {"connection.uri": uri, "database": database, "collection": collection}
    return spark.read.format("mongodb").options(**names, **options).load()


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table behind JDBC; give partitionColumn, lowerBound, upperBound, numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
