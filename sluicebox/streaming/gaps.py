"""What a consumer has seen of a topic: runs of offsets without a gap, held as keyed state.

The state is per block of offsets of a partition, not per partition, so a topic
with one busy partition is spread over all tasks and no state grows with the
topic. A block holds its contiguous runs ``[low, high)`` and, of offsets that
came again, how often. Finished blocks are a single run.

Messages without an offset are not counted. Order does not matter, neither does
the size of micro-batches; a restart from the checkpoint goes on where it ended.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Offsets of one partition that share a state.
BLOCK_OFFSETS = 1 << 16

_STATE = "low array<bigint>, high array<bigint>, again array<bigint>, times array<bigint>"
_SEEN = f"partition int, block bigint, {_STATE}"


def add_to_runs(low: np.ndarray, high: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs ``[low, high)`` with ``offsets`` (distinct, ascending) added, and those that were in them before."""
    at = np.searchsorted(low, offsets, side="right") - 1
    inside = (at >= 0) & (offsets < high[np.maximum(at, 0)]) if len(low) else np.zeros(len(offsets), bool)
    fresh = offsets[~inside]
    starts = np.sort(np.concatenate([low, fresh]))
    stops = np.sort(np.concatenate([high, fresh + 1]))
    # Runs do not overlap, so a run ends where the next start is not the stop before it.
    breaks = np.flatnonzero(starts[1:] != stops[:-1])
    first = np.concatenate([[0], breaks + 1]) if len(starts) else breaks
    last = np.concatenate([breaks, [len(stops) - 1]]) if len(starts) else breaks
    return starts[first.astype(int)], stops[last.astype(int)], offsets[inside]


def add_repeats(again: np.ndarray, times: np.ndarray, offsets: np.ndarray, counts: np.ndarray):
    """Counts of repeated offsets, summed by offset and ascending."""
    every, place = np.unique(np.concatenate([again, offsets]), return_inverse=True)
    summed = np.zeros(len(every), np.int64)
    np.add.at(summed, place, np.concatenate([times, counts]))
    return every[summed > 0], summed[summed > 0]


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else ([], [], [], [])
    low, high, again, times = (np.array(x, np.int64) for x in held)
    for batch in batches:
        offsets, counts = np.unique(batch["offset"].to_numpy(np.int64), return_counts=True)
        low, high, known = add_to_runs(low, high, offsets)
        more = counts - 1 + np.isin(offsets, known, assume_unique=True)
        again, times = add_repeats(again, times, offsets, more)
    now = tuple(x.tolist() for x in (low, high, again, times))
    state.update(now)
    row = {"partition": [key[0]], "block": [key[1]]}
    yield pd.DataFrame(row | {n: [v] for n, v in zip(("low", "high", "again", "times"), now, strict=True)})


def follow_offsets(stream: DataFrame, block_offsets: int = BLOCK_OFFSETS) -> DataFrame:
    """``partition, block, low, high, again, times`` of each block that a micro-batch touched, in update mode."""
    block = F.floor(F.col("offset") / F.lit(block_offsets)).cast("bigint").alias("block")
    slim = stream.filter("partition IS NOT NULL AND offset IS NOT NULL")
    slim = slim.select(F.col("partition").cast("int"), block, F.col("offset").cast("bigint"))
    grouped = slim.groupBy("partition", "block")
    return grouped.applyInPandasWithState(_follow, _SEEN, _STATE, "update", GroupStateTimeout.NoTimeout)


def _latest(spark, path: str) -> DataFrame:
    """The last state of each block; empty where nothing has arrived yet."""
    try:
        states = spark.read.schema(f"{_SEEN}, batch bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SEEN)
    newest = Window.partitionBy("partition", "block").orderBy(F.desc("batch"))
    return states.withColumn("newest", F.row_number().over(newest)).filter("newest = 1").drop("newest", "batch")


def _announced(start: DataFrame, end: DataFrame) -> DataFrame:
    first = start.select("partition", F.col("offset").alias("first"))
    return F.broadcast(first.join(end.select("partition", F.col("offset").alias("stop")), "partition"))


def _runs(seen: DataFrame, announced: DataFrame) -> DataFrame:
    """``partition, runs``: of each block its runs inside the announced offsets of the partition."""
    cut = F.expr(
        "filter(transform(arrays_zip(low, high), r -> named_struct('low', greatest(r.low, first), 'high', "
        "least(r.high, stop))), r -> r.low < r.high)"
    )
    return seen.join(announced, "partition").select("partition", cut.alias("runs")).filter("size(runs) > 0")


def gap_report(seen: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """``partition, kind, first_offset, end_offset, messages`` of what is wrong with the announced offsets.

    ``seen`` has the last state of each block; ``start`` and ``end`` (exclusive)
    are ``partition, offset`` frames with a row per partition. A ``gap`` is a
    longest range that never came, with its size; a ``repeat`` is an offset that
    came more than once, with the number of messages too many. A partition of
    which nothing came is one gap; one without announced messages has none.
    """
    announced = _announced(start, end)
    runs = _runs(seen, announced)
    between = F.expr(
        "transform(slice(runs, 1, size(runs) - 1), (r, i) -> named_struct('first_offset', r.high, 'end_offset', runs[i + 1].low))"
    )
    inner = runs.select("partition", F.explode(between).alias("g")).select("partition", "g.first_offset", "g.end_offset")
    # The window has one row per block, whatever the gaps in it; the announced end closes the last gap.
    edges = runs.select("partition", F.expr("runs[0].low").alias("low"), F.expr("element_at(runs, -1).high").alias("high"))
    edges = edges.unionByName(announced.select("partition", F.col("stop").alias("low"), F.col("stop").alias("high")))
    in_order = Window.partitionBy("partition").orderBy("low", "high")
    before = F.coalesce(F.lag("high").over(in_order), F.col("first")).alias("first_offset")
    outer = edges.join(announced, "partition").select("partition", before, F.col("low").alias("end_offset"))
    gaps = inner.unionByName(outer.filter("first_offset < end_offset")).select(
        "partition", F.lit("gap").alias("kind"), "first_offset", "end_offset",
        (F.col("end_offset") - F.col("first_offset")).alias("messages"),
    )
    doubled = seen.select("partition", F.explode(F.arrays_zip("again", "times")).alias("r")).join(announced, "partition")
    doubled = doubled.filter("r.again >= first AND r.again < stop").select(
        "partition", F.lit("repeat").alias("kind"), F.col("r.again").alias("first_offset"),
        (F.col("r.again") + 1).alias("end_offset"), F.col("r.times").alias("messages"),
    )
    return gaps.unionByName(doubled)


def missing_messages(seen: DataFrame, start: DataFrame, end: DataFrame) -> int:
    """Announced offsets that have not come yet."""
    announced = _announced(start, end)
    wanted = announced.agg(F.sum(F.greatest(F.col("stop") - F.col("first"), F.lit(0)))).first()[0] or 0
    size = F.expr("aggregate(runs, 0L, (n, r) -> n + r.high - r.low)")
    return wanted - (_runs(seen, announced).agg(F.sum(size)).first()[0] or 0)


def _writer(stream: DataFrame, path: str, checkpoint: str):
    def keep(touched: DataFrame, batch: int) -> None:
        touched.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/run={batch}")

    return (
        follow_offsets(stream)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
    )


def collect_until_complete(
    stream: DataFrame, start: DataFrame, end: DataFrame, path: str, checkpoint: str, patience: float = 10.0
) -> DataFrame:
    """Follow ``stream`` until every announced offset has come, and report what is wrong.

    It ends by the announced count, however long the topic goes on, or when no
    new offset has come for ``patience`` seconds. Each micro-batch writes the
    blocks it touched to a folder named after it, so a repeated batch replaces
    its own; called again with the same folders it goes on where it ended.
    """
    spark = stream.sparkSession
    query = _writer(stream, path, checkpoint).start()
    try:
        left, since = None, time.monotonic()
        while query.isActive:
            done = query.lastProgress
            if done is not None:
                now = missing_messages(_latest(spark, path), start, end)
                if now == 0:
                    break
                if now != left:
                    left, since = now, time.monotonic()
                elif time.monotonic() - since > patience and not query.status["isDataAvailable"]:
                    break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return gap_report(_latest(spark, path), start, end)


def gaps_of_what_is_there(stream: DataFrame, start: DataFrame, end: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The report after all that the stream has now; it waits for nothing."""
    _writer(stream, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return gap_report(_latest(stream.sparkSession, path), start, end)
