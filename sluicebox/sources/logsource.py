"""The message log as a Spark data source that reads stretches of offsets.

An offset of the stream is, for each partition of the topic, the next message to
read, as it is for a Kafka source. What there is comes from the commit log, so a
stream sees committed runs only and ends its batches where runs end. A batch is
planned from the tables of file ranges: files without a wanted offset are not
opened, row groups without one are not read, and small files share a task.

Planning and reading go through pyarrow's file systems, as neither has a JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sluicebox.sources.manifest import COMMITS, entry_name, ranges_folder, snapshot, versions

FORMAT = "sluicebox_log"
SCHEMA = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"
_ARROW = pa.schema(
    [
        ("key", pa.binary()),
        ("value", pa.binary()),
        ("topic", pa.string()),
        ("partition", pa.int32()),
        ("offset", pa.int64()),
        ("timestamp", pa.timestamp("us", "UTC")),
    ]
)
#: Messages of small files that one task reads, and of one batch that goes to Spark.
TASK_MESSAGES, BATCH_MESSAGES = 500_000, 1024


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ArrowStore:
    """Entries of a topic without a JVM."""

    def __init__(self, folder: str):
        self._system, path = _place(folder)
        self._path = f"{path.rstrip('/')}/{COMMITS}"

    def names(self) -> list[str]:
        found = self._system.get_file_info(fs.FileSelector(self._path, allow_not_found=True))
        return [f.base_name for f in found]

    def text(self, name: str) -> str:
        with self._system.open_input_file(f"{self._path}/{name}") as file:
            return file.read().decode()


@dataclass
class Stretch(InputPartition):
    """Files of one partition and the offsets wanted of them: ``low <= offset < high``."""

    partition: int
    low: int
    high: int
    paths: tuple[str, ...]


def plan_stretches(folder: str, start: Mapping[int, int], end: Mapping[int, int]) -> list[Stretch]:
    """The files that hold the offsets from ``start`` to below ``end``, in tasks."""
    wanted = {p: (start.get(p, 0), e) for p, e in end.items() if e > start.get(p, 0)}
    if not wanted:
        return []
    store = ArrowStore(folder)
    out: list[Stretch] = []
    held: dict[int, tuple[list[str], int]] = {}

    def flush(p: int) -> None:
        if p in held:
            out.append(Stretch(p, *wanted[p], tuple(held.pop(p)[0])))

    for version in versions(store):
        entry = json.loads(store.text(entry_name(version)))
        # A run is looked into only if it has a wanted offset.
        if not any(
            int(p) in wanted and entry["end"][p] > wanted[int(p)][0] and o < wanted[int(p)][1]
            for p, o in entry["start"].items()
        ):
            continue
        system, path = _place(ranges_folder(folder, entry["run_id"]))
        ranges = ds.dataset(path, filesystem=system, format="parquet")
        for row in sorted(ranges.to_table().to_pylist(), key=lambda r: (r["partition"], r["first"])):
            p = row["partition"]
            if p not in wanted or row["last"] < wanted[p][0] or row["first"] >= wanted[p][1]:
                continue
            paths, messages = held.get(p, ([], 0))
            if paths and messages + row["messages"] > TASK_MESSAGES:
                flush(p)
                paths, messages = [], 0
            held[p] = ([*paths, row["path"]], messages + row["messages"])
    for p in list(held):
        flush(p)
    return out


def read_stretch(stretch: Stretch, topic: str) -> Iterator[pa.RecordBatch]:
    """The wanted messages of a task's files, in Arrow batches."""
    offset = ds.field("offset")
    for uri in stretch.paths:
        system, path = _place(uri)
        file = ds.dataset(path, filesystem=system, format="parquet")
        scanner = file.scanner(
            columns=["key", "value", "offset", "timestamp"],
            filter=(offset >= stretch.low) & (offset < stretch.high),
            batch_size=BATCH_MESSAGES,
            batch_readahead=1,
            fragment_readahead=1,
        )
        for batch in scanner.to_batches():
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").cast(pa.binary()),
                        batch.column("value").cast(pa.binary()),
                        pa.array([topic] * batch.num_rows, pa.string()),
                        pa.array([stretch.partition] * batch.num_rows, pa.int32()),
                        batch.column("offset"),
                        batch.column("timestamp").cast(pa.timestamp("us", "UTC"), safe=False),
                    ],
                    schema=_ARROW,
                )


class _Bounds:
    """What both readers know: the topic, and offsets from an option's text or from the commit log."""

    def __init__(self, options: Mapping[str, str]):
        self.folder, self.topic = options["folder"], options["topic"]
        self.count = int(options["partitions"])
        self.starting = options.get("starting", "earliest")
        self.ending = options.get("ending", "latest")

    def offsets(self, which: str) -> dict[int, int]:
        if which == "earliest":
            return dict.fromkeys(range(self.count), 0)
        if which == "latest":
            return snapshot(ArrowStore(self.folder)).starts(self.count)
        given = {int(p): int(o) for p, o in json.loads(which).items()}
        return {p: given.get(p, 0) for p in range(self.count)}


class LogReader(_Bounds, DataSourceReader):
    """A batch between two offsets of each partition."""

    def partitions(self) -> Sequence[Stretch]:
        return plan_stretches(self.folder, self.offsets(self.starting), self.offsets(self.ending))

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return read_stretch(partition, self.topic)


class LogStreamReader(_Bounds, DataSourceStreamReader):
    """Micro-batches from where the last one ended to what is committed."""

    def initialOffset(self) -> dict:
        return _named(self.offsets(self.starting))

    def latestOffset(self) -> dict:
        latest = self.offsets("latest")
        if self.starting not in ("earliest", "latest"):
            # Explicit starts may lie beyond what there is; nothing is read until the topic gets there.
            latest = {p: max(o, latest[p]) for p, o in self.offsets(self.starting).items()}
        return _named(latest)

    def partitions(self, start: dict, end: dict) -> Sequence[Stretch]:
        return plan_stretches(self.folder, {int(p): o for p, o in start.items()}, {int(p): o for p, o in end.items()})

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return read_stretch(partition, self.topic)


def _named(offsets: Mapping[int, int]) -> dict[str, int]:
    return {str(p): o for p, o in sorted(offsets.items())}


class LogDataSource(DataSource):
    """``spark.read`` and ``spark.readStream`` of format ``sluicebox_log``.

    Options: ``folder`` and ``topic``, ``partitions``, ``starting`` (``earliest``,
    ``latest`` or ``{"0": 17, …}``) and, for a batch, ``ending``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(self.options)
