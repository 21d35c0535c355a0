"""The message log: what a topic is to the rest of the package.

Two formats share one shape, that of Spark's Kafka rows. ``log`` is a parquet
folder ``topic=…/run_id=…/partition=…`` that works wherever Spark can write;
``kafka`` goes through Spark's Kafka connector, which has to be on the class
path (it is not in the test environment, so that branch is untested).

Each run writes a folder of its own and is then committed to the topic's commit
log (``sources/manifest.py``). Readers take committed runs only, so a failed run is
never seen, and of two writers at a time the one that commits second is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.sources import manifest
from sluicebox.sources.logsource import FORMAT, LogDataSource
from sluicebox.sources.manifest import HadoopStore, Snapshot
from sluicebox.tables import small_table

LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("partition", T.IntegerType()),
    ]
)
COLUMNS = ["key", "value", "topic", "partition", "offset", "timestamp"]


@dataclass(frozen=True)
class MessageLog:
    """A parquet log below ``root``, with a fixed number of partitions per topic."""

    root: str
    partitions: int
    run_prefix: str = field(default="run")

    def _folder(self, topic: str) -> str:
        return f"{self.root}/topic={topic}"

    def new_run(self) -> str:
        return f"{self.run_prefix}-{uuid.uuid4().hex}"

    def snapshot(self, spark: SparkSession, topic: str, version: int | None = None) -> Snapshot:
        """The committed runs of a topic and where its partitions end, from its commit log alone."""
        return manifest.snapshot(HadoopStore(spark, self._folder(topic)), version)

    def high_watermarks(self, spark: SparkSession, topic: str, version: int | None = None) -> DataFrame:
        """``partition, offset``: the next free offset of each partition. No message is looked at."""
        ends = self.snapshot(spark, topic, version).starts(self.partitions)
        return small_table(spark, sorted(ends.items()), {"partition": "int", "offset": "bigint"})

    def read(self, spark: SparkSession, topic: str, version: int | None = None) -> DataFrame:
        """All messages of a topic's committed runs, as of ``version``; none if nothing was ever committed."""
        folder = self._folder(topic)
        runs = self.snapshot(spark, topic, version).runs
        if not runs:
            log = spark.createDataFrame([], LOG_SCHEMA)
        else:
            paths = [f"{folder}/run_id={run}" for run in runs]
            log = spark.read.schema(LOG_SCHEMA).option("basePath", folder).parquet(*paths)
        return log.withColumn("topic", F.lit(topic)).select(*COLUMNS)

    def read_between(
        self, spark: SparkSession, topic: str, starting: Mapping[int, int] | str, ending: Mapping[int, int] | str
    ) -> DataFrame:
        """Messages from ``starting`` to below ``ending`` of each partition; other files are not opened."""
        reader = self._source(spark, spark.read.format(FORMAT), topic, starting)
        return reader.option("ending", _bound(ending)).load().select(*COLUMNS)

    def read_stream(
        self, spark: SparkSession, topic: str, starting: Mapping[int, int] | str = "earliest"
    ) -> DataFrame:
        """The topic as a stream of committed runs; a topic nobody wrote to waits.

        ``starting`` is ``earliest``, ``latest`` or the first wanted offset of each
        partition. A query that has a checkpoint goes on from there instead.
        """
        return self._source(spark, spark.readStream.format(FORMAT), topic, starting).load().select(*COLUMNS)

    def _source(self, spark: SparkSession, reader, topic: str, starting: Mapping[int, int] | str):
        spark.dataSource.register(LogDataSource)
        options = {"folder": self._folder(topic), "topic": topic, "partitions": str(self.partitions)}
        return reader.options(**options, starting=_bound(starting))

    def write(
        self, messages: DataFrame, topic: str, run_id: str | None = None, base: Snapshot | None = None
    ) -> str:
        """Write ``partition, offset, value`` rows as one run and commit it; returns its id.

        Offsets go on from ``base``, by default from what the topic has now. A run
        with gaps or repeats (``NotDense``) is not committed, and neither is one that
        another run has overtaken since ``base`` (``ConcurrentWrite``).
        """
        spark = messages.sparkSession
        base = base or self.snapshot(spark, topic)
        run_id = run_id or self.new_run()
        rows = messages.select(
            F.lit(None).cast("binary").alias("key"),
            F.col("value").cast("binary").alias("value"),
            F.col("offset").cast("bigint").alias("offset"),
            F.current_timestamp().alias("timestamp"),
            F.col("partition").cast("int").alias("partition"),
        )
        folder = self._folder(topic)
        target = f"{folder}/run_id={run_id}"
        rows.write.mode("errorifexists").partitionBy("partition").parquet(target)
        run = spark.read.schema(LOG_SCHEMA).option("basePath", folder).parquet(target)
        ranges = manifest.write_ranges(spark, run, folder, run_id)
        ends = manifest.dense_ends(ranges, base.starts(self.partitions))
        manifest.commit(HadoopStore(spark, folder), base, run_id, ends)
        return run_id


def _bound(offsets: Mapping[int, int] | str) -> str:
    return offsets if isinstance(offsets, str) else json.dumps({str(p): o for p, o in sorted(offsets.items())})


# Producer settings of a reliable export.
KAFKA_WRITE_OPTIONS = {
    "kafka.acks": "all",
    "kafka.enable.idempotence": "true",
    "kafka.compression.type": "lz4",
}


def offsets_json(topic: str, offsets: Mapping[int, int]) -> str:
    """Offsets of a topic in the form of ``startingOffsets`` and ``endingOffsets``."""
    return json.dumps({topic: {str(p): o for p, o in sorted(offsets.items())}})


@dataclass(frozen=True)
class KafkaLog:
    """A Kafka topic through Spark's connector. Not tested here: no connector, no broker."""

    bootstrap_servers: str
    options: tuple[tuple[str, str], ...] = ()

    def _options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.bootstrap_servers, **dict(self.options)}

    def write(self, messages: DataFrame, topic: str, run_id: str | None = None) -> None:
        """At least once: a repeated task sends its messages again."""
        rows = messages.select(
            F.lit(None).cast("binary").alias("key"),
            F.col("value").cast("binary").alias("value"),
            F.lit(topic).alias("topic"),
            F.col("partition").cast("int").alias("partition"),
        )
        options = {**KAFKA_WRITE_OPTIONS, **self._options()}
        rows.write.format("kafka").options(**options).save()

    def read(
        self, spark: SparkSession, topic: str, starting: str = "earliest", ending: str = "latest"
    ) -> DataFrame:
        offsets = {"subscribe": topic, "startingOffsets": starting, "endingOffsets": ending}
        return spark.read.format("kafka").options(**self._options(), **offsets).load().select(*COLUMNS)

    def read_stream(
        self,
        spark: SparkSession,
        topic: str,
        starting: str = "latest",
        partitions: Sequence[int] | None = None,
    ) -> DataFrame:
        """The topic as a stream from its end offsets, or some of its partitions only."""
        source = {"subscribe": topic}
        if partitions is not None:
            source = {"assign": json.dumps({topic: list(partitions)})}
        offsets = {**source, "startingOffsets": starting}
        return spark.readStream.format("kafka").options(**self._options(), **offsets).load().select(*COLUMNS)
