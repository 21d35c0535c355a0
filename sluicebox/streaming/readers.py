"""A topic as a stream: where to start, where to stop, and running counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicebox.operators.collect import between_offsets


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def from_offsets(stream: DataFrame, start: DataFrame) -> DataFrame:
    """Messages at or after the start offset of their partition.

    ``start`` is a ``partition, offset`` frame; with the high watermarks of the
    topic it means "only what comes from now on".
    """
    first = F.broadcast(start.select("partition", F.col("offset").alias("_first")))
    return stream.join(first, "partition").filter(F.col("offset") >= F.col("_first")).drop("_first")


def up_to_offsets(stream: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """Messages of one export: from its start offsets up to its end offsets."""
    return between_offsets(stream, start, end)


def running_counts(stream: DataFrame) -> DataFrame:
    """``partition, messages`` so far; state is one number per partition."""
    return stream.groupBy("partition").agg(F.count("*").alias("messages"))


def running_sizes(stream: DataFrame) -> DataFrame:
    """``partition, messages, bytes`` so far."""
    return stream.groupBy("partition").agg(
        F.count("*").alias("messages"), F.sum(F.octet_length("value")).alias("bytes")
    )


def watch_counts(stream: DataFrame, name: str, checkpoint: str, every: str = "3 seconds") -> StreamingQuery:
    """Keep ``running_counts`` in the memory table ``name``, renewed ``every`` interval.

    The table holds one row per partition of the topic.
    """
    writer = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drain_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write all that the stream has now to parquet, and read it back.

    The checkpoint makes a second call go on where the first one ended.
    """
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    try:
        return spark.read.schema(stream.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Nothing has arrived yet, so nothing was written.
        return spark.createDataFrame([], stream.schema)


def drain_counts(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a grouped stream over all that is there now; its last state as a table.

    Each micro-batch writes the full state to a folder named after it, so a
    repeated batch replaces its own folder.
    """

    def keep(state: DataFrame, batch: int) -> None:
        state.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/run={batch}")

    query = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = counts.sparkSession
    try:
        states = spark.read.schema(f"{_ddl(counts)}, batch bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Nothing has arrived yet, so no batch was run.
        return spark.createDataFrame([], counts.schema)
    latest = states.agg(F.max("batch").alias("batch"))
    return states.join(F.broadcast(latest), "batch").select(*counts.columns)
