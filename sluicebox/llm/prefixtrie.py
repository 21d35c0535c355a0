"""The prefix trie of conversations, its totals by time-forward processing.

A conversation is rebuilt from the first turns of the one that opens its hundred
and its own turns behind as many; every distinct sequence of first turns of the
rebuilt ones is a node, from the textless root. A node knows its members, its
children, the leaves below it and what sharing saves.

**Order without a task per conversation.** Turns get their place by range
partitions over (conversation, turn): a task numbers what it holds, one row per
task says how its last conversation went on, and what lies in earlier tasks is
added. The key of a node is a polynomial over its turns in two lanes modulo
2^61 - 1, which can be carried across such a border; so a conversation with a
third of all turns is spread over many tasks.

**Totals.** Nodes are sorted by reverse level order, and each passes its totals to
its parent through a priority queue that spills sorted runs; a node takes what
is addressed to it, adds its own and passes the sum on. Nodes fall into three kinds:

* *heavy*, with more than ``threshold`` members: fewer than ``MOST_HEAVY`` of them,
  as the threshold follows the number of rows; only these are broadcast;
* *tails*, with one member: their totals are known without a walk (one leaf,
  nothing saved), and the uppermost of each is counted at its parent;
* the rest, in shards of whole subtrees below heavy nodes.

Shards are walked first, each in a task; the totals of their roots are grouped by
parent and a last walk goes over the heavy nodes alone.

Members that end in a node are hashed from texts of ``CHUNK`` ids that are made in
parallel; a single task only runs the hash over them, in order, and holds one.

Rows without a ``conv_id`` belong to no conversation. Turns are in order of
``turn``, null first, and of the turn's hash where that is equal; repeated rows are
turns of their own. Null role or text is empty. An empty table has no node, not
even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.llm import files
from sluicebox.llm.common import tasks_for, written
from sluicebox.session import scratch_dir

#: Conversations of one block share the first turns of its first one; so many of them at most.
BLOCK, MOST_SHARED = 100, 5
LEAST_HEAVY, MOST_HEAVY = 1_000, 100_000
#: Messages a queue holds in memory, ids in a text of ends, rows of a batch that goes on.
QUEUE_ENTRIES, CHUNK, BATCH_ROWS = 200_000, 1024, 8192

PRIME = (1 << 61) - 1
# Two lanes of the polynomial; any two bases will do.
BASES = (1_000_003_000_000_007, 2_000_029_000_000_033)

KEY = ["depth", "k1", "k2"]


# -- order and keys


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, x1, x2, chars``: a turn as two hashes below the prime and its text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))

    def lane(*columns: Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(PRIME))

    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        lane(role, text).alias("x1"),
        lane(F.lit(1), text, role).alias("x2"),
        F.length(text).cast("bigint").alias("chars"),
    )


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal ids."""
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return starts, np.diff(np.append(starts, len(ids)))


def _numbered(turns: DataFrame, tasks: int) -> DataFrame:
    """``conv_id, place, x1, x2, chars``: turns with their place in their conversation, from 1."""

    def run(batches):
        part, before, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            starts, sizes = _runs(ids)
            place = np.arange(1, len(ids) + 1) - np.repeat(starts, sizes)
            if ids[0] == before:
                place[: sizes[0]] += held
            before, held = ids[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(place), *batch.columns[2:]],
                names=["part", "conv_id", "near", "x1", "x2", "chars"],
            )

    order = ["conv_id", "turn", "x1", "x2"]
    dealt = turns.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    found = written(
        dealt.mapInArrow(run, "part int, conv_id bigint, near bigint, x1 bigint, x2 bigint, chars bigint"), "trie-turns"
    )
    # One row per task.
    seen = found.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "near")).alias("last"))
    carried, before, held = [], None, 0
    for row in sorted(seen.collect()):
        if row["first"] == before:
            carried.append((row["part"], before, held))
        whole = row["last"]["conv_id"] == before
        before, held = row["last"]["conv_id"], row["last"]["near"] + (held if whole else 0)
    place = F.col("near")
    if carried:
        borders = found.sparkSession.createDataFrame(carried, "part int, conv_id bigint, held bigint")
        found = found.join(F.broadcast(borders), ["part", "conv_id"], "left")
        place = place + F.coalesce("held", F.lit(0))
    return found.select("conv_id", place.alias("place"), "x1", "x2", "chars")


def _rebuilt(turns: DataFrame, tasks: int) -> DataFrame:
    """``conv_id, source, place, x1, x2, chars``: a root row (source 0), shared turns (1) and own turns (2)."""
    places = _numbered(turns, tasks)
    own = places.filter(F.col("place") > shared_turns(F.col("conv_id")))
    # At most MOST_SHARED rows per block, of which each map task sends no more either.
    order = Window.partitionBy("conv_id").orderBy("turn", "x1", "x2")
    heads = (
        turns.filter(F.col("conv_id") % BLOCK == 0)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= MOST_SHARED)
        .select(F.col("conv_id").alias("opening"), "place", "x1", "x2", "chars")
    )
    all_of_them = turns.select("conv_id").distinct()
    opening = F.col("conv_id") - F.col("conv_id") % BLOCK
    shared = all_of_them.withColumn("opening", opening).join(heads, "opening")
    shared = shared.filter(F.col("place") <= shared_turns(F.col("conv_id")))
    nothing = F.lit(0).cast("bigint")
    columns = ["place", "x1", "x2", "chars"]
    roots = all_of_them.select("conv_id", F.lit(0).alias("source"), *[nothing.alias(c) for c in columns])
    return roots.unionByName(shared.select("conv_id", F.lit(1).alias("source"), *columns)).unionByName(
        own.select("conv_id", F.lit(2).alias("source"), *columns)
    )


_PATH = (
    "part int, conv_id bigint, near bigint, c1 bigint, c2 bigint, b1 bigint, b2 bigint, chars bigint, "
    "begun boolean, last boolean, final boolean"
)
_PATH_NAMES = [column.split()[0] for column in _PATH.split(", ")]


def _walk(batches) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PATH`` from rebuilt turns in order: depth, key and parent's key as far as this task can tell.

    ``begun`` tells that the conversation begins in this task; else depth counts and
    keys start from where the task before it ends.
    """
    part = TaskContext.get().partitionId()
    conv, near, begun, one, two = None, 0, False, 0, 0
    waiting, rows = None, []

    def out() -> pa.RecordBatch:
        columns = [[part] * len(rows), *(list(c) for c in zip(*rows, strict=True))]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PATH_TYPES, strict=True)], _PATH_NAMES)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
        for c, source, x1, x2, chars in zip(*columns, strict=True):
            if waiting:
                rows.append((*waiting, c != conv, False))
            if c != conv:
                conv, near, begun, one, two = c, 0, source == 0, 0, 0
            before = one, two
            if source:
                near += 1
                one, two = (one * BASES[0] + x1) % PRIME, (two * BASES[1] + x2) % PRIME
            waiting = (conv, near, one, two, *before, chars, begun)
            if len(rows) >= BATCH_ROWS:
                yield out()
    if waiting:
        # Whether a task's last row ends its conversation shows in the next task only.
        rows.append((*waiting, True, True))
        yield out()


_PATH_TYPES = [pa.int32()] + [pa.int64()] * 7 + [pa.bool_()] * 3


def _paths(rebuilt: DataFrame, tasks: int) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, chars, last``: each node on the way of each conversation, with its parent's key."""
    order = ["conv_id", "source", "place"]
    dealt = rebuilt.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    found = written(dealt.mapInArrow(_walk, _PATH), "trie-paths")
    # One row per task.
    seen = found.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "near", "c1", "c2", "begun")).alias("last")
    )
    carried: dict[int, tuple[int, int, int, int]] = {}
    goes_on: set[int] = set()
    conv, at, lanes, previous = None, 0, (0, 0), None
    for part, first, last in sorted(seen.collect()):
        if first == conv:
            carried[part] = (conv, at, *lanes)
            goes_on.add(previous)
        own = (last["c1"], last["c2"])
        if last["conv_id"] == conv:
            lanes = tuple((a * pow(b, last["near"], PRIME) + c) % PRIME for a, b, c in zip(lanes, BASES, own, strict=True))
            at += last["near"]
        else:
            lanes, at = own, last["near"]
        conv, previous = last["conv_id"], part

    def resolve(batches):
        for batch in batches:
            data = {n: batch.column(n).to_numpy(zero_copy_only=False).copy() for n in _PATH_NAMES}
            last = data["last"] & ~(data["final"] & np.isin(data["part"], list(goes_on)))
            near = data["near"].tolist()
            for i in np.flatnonzero(~data["begun"]).tolist():
                conv, before, *border = carried[int(data["part"][i])]
                data["near"][i] += before
                for base, held, key, parent in zip(BASES, border, ("c1", "c2"), ("b1", "b2"), strict=True):
                    power = pow(base, near[i] - 1, PRIME)
                    data[key][i] = (held * power * base + int(data[key][i])) % PRIME
                    data[parent][i] = (held * power + int(data[parent][i])) % PRIME
            yield pa.RecordBatch.from_arrays(
                [pa.array(data[n]) for n in ("conv_id", "near", "c1", "c2", "b1", "b2", "chars")] + [pa.array(last)],
                names=["conv_id", "depth", "k1", "k2", "p1", "p2", "chars", "last"],
            )

    schema = "conv_id bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, chars bigint, last boolean"
    return written(found.mapInArrow(resolve, schema), "trie-rows")


# -- totals


class SpillingQueue:
    """Messages in order of their address; what is beyond ``limit`` of them waits in sorted runs in the shared folder."""

    def __init__(self, folder: str, limit: int = QUEUE_ENTRIES):
        self.folder, self.limit = folder, limit
        self.heap: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []
        self.heads: list[tuple] = []
        self.paths: list[str] = []

    def push(self, message: tuple) -> None:
        if len(self.heap) >= self.limit:
            self._spill()
        heapq.heappush(self.heap, message)

    def _spill(self) -> None:
        self.heap.sort()
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        with files.open_for_writing(path) as out:
            out.write(np.array(self.heap, "<i8").tobytes())
        run = self._read(path, len(self.heap[0]))
        self.heap = []
        self.paths.append(path)
        self.runs.append(run)
        heapq.heappush(self.heads, (next(run), len(self.runs) - 1))

    @staticmethod
    def _read(path: str, width: int) -> Iterator[tuple]:
        with files.open_for_reading(path) as file:
            while data := file.read(8 * width * 4096):
                yield from map(tuple, np.frombuffer(data, "<i8").reshape(-1, width).tolist())

    def least(self) -> tuple | None:
        tops = [t for t in (self.heap[0] if self.heap else None, self.heads[0][0] if self.heads else None) if t]
        return min(tops) if tops else None

    def pop(self) -> tuple:
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        message, run = heapq.heappop(self.heads)
        following = next(self.runs[run], None)
        if following is not None:
            heapq.heappush(self.heads, (following, run))
        return message

    def close(self) -> None:
        for path in self.paths:
            files.remove(path)
        self.paths = []


_WALKED = "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, top boolean, n_children bigint, n_leaves bigint, saved bigint"
_WALKED_NAMES = [column.split()[0] for column in _WALKED.split(", ")]


def _totals(nodes: DataFrame, tasks: int, folder: str, limit: int = QUEUE_ENTRIES) -> DataFrame:
    """Children, leaves and savings of each node's subtree, by a walk in reverse level order in each ``shard``.

    ``nodes`` has ``shard, depth, k1, k2, p1, p2, top, own, children, leaves, saved``;
    the last three come from subtrees that are not among the nodes. All of a
    shard's nodes but those with ``top`` have their parent in it.
    """

    def run(batches):
        queue, shard, rows = SpillingQueue(folder, limit), None, []

        def out():
            columns = zip(*rows, strict=True)
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, pa.bool_() if n == "top" else pa.int64()) for n, c in zip(_WALKED_NAMES, columns, strict=True)],
                _WALKED_NAMES,
            )
            rows.clear()
            return made

        try:
            for batch in batches:
                for own_shard, depth, k1, k2, p1, p2, top, own, children, leaves, saved in zip(
                    *[c.to_pylist() for c in batch.columns], strict=True
                ):
                    if own_shard != shard:
                        if queue.least():
                            raise ValueError("a total found no node")
                        shard = own_shard
                    address = (-depth, k1, k2)
                    while (message := queue.least()) and message[:3] == address:
                        _, _, _, more_leaves, more_saved = queue.pop()
                        children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
                    saved += own
                    leaves = leaves if children else 1
                    rows.append((depth, k1, k2, p1, p2, top, children, leaves, saved))
                    if not top:
                        queue.push((1 - depth, p1, p2, leaves, saved))
                    if len(rows) >= BATCH_ROWS:
                        yield out()
            if rows:
                yield out()
            if queue.least():
                raise ValueError("a total found no node")
        finally:
            queue.close()

    columns = ["shard", *KEY, "p1", "p2", "top", "own", "children", "leaves", "saved"]
    order = ["shard", F.desc("depth"), "k1", "k2"]
    return nodes.select(*columns).repartition(tasks, "shard").sortWithinPartitions(*order).mapInArrow(run, _WALKED)


def _given(messages: DataFrame, to: DataFrame) -> DataFrame:
    """``to`` with the sums of ``messages`` (``depth, p1, p2, leaves, saved`` of children) as ``children, leaves, saved``."""
    sums = messages.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    named = ["children", "leaves", "saved"]
    return to.join(sums, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in named})


def _ends(rows: DataFrame, tasks: int) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of each node in which a conversation ends."""
    schema = "depth bigint, k1 bigint, k2 bigint, first bigint, ids string"

    def texts(batches):
        key, ids, rows = None, [], []

        def out():
            columns = zip(*rows, strict=True)
            made = [pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(columns)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, ["depth", "k1", "k2", "first", "ids"])

        for batch in batches:
            for *own, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != key or len(ids) >= CHUNK:
                    if ids:
                        rows.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = own, []
                    if len(rows) >= CHUNK:
                        yield out()
                ids.append(conv)
        if ids:
            rows.append((*key, ids[0], ",".join(map(str, ids))))
            yield out()

    def digests(batches):
        key, state, rows = None, None, []
        for batch in batches:
            for *own, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if own == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    rows.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids.encode())
            if rows:
                yield _digest_batch(rows)
                rows = []
        if key:
            yield _digest_batch([(*key, state.hexdigest())])

    ends = rows.filter("last").select(*KEY, "conv_id")
    order = [*KEY, "conv_id"]
    pieces = ends.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(texts, schema)
    dealt = pieces.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInArrow(digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, [*KEY, "ends_sha256"])


def trie_nodes(
    conversations: DataFrame, least_heavy: int = LEAST_HEAVY, queue_entries: int = QUEUE_ENTRIES
) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = conversations.sparkSession
    tasks = tasks_for(conversations)
    folder = scratch_dir(spark, "trie-queues")
    files.make_folder(folder)
    rows = _paths(_rebuilt(turns_of(conversations), tasks), tasks)
    # A heavy node has a row of every member, so there are fewer than rows / threshold of them.
    threshold = max(least_heavy, -(-rows.count() // MOST_HEAVY))
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count(F.when(F.col("last"), 1)).alias("n_ends"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
        F.max("chars").alias("chars"),
    )
    nodes = written(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"), "trie-nodes")
    tails, heavy = nodes.filter("n_convs = 1"), nodes.filter(F.col("n_convs") > threshold)
    shared = nodes.filter((F.col("n_convs") > 1) & (F.col("n_convs") <= threshold))

    # The uppermost light node on the way of each conversation, which names its shard.
    heavy_keys = F.broadcast(heavy.select(*KEY, F.lit(True).alias("heavy")))
    heavy_parents = F.broadcast(
        heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    )
    below = rows.join(heavy_parents, ["depth", "p1", "p2"], "left_semi").unionByName(rows.filter("depth = 0"))
    tops = below.join(heavy_keys, KEY, "left_anti").select(
        "conv_id", F.col("depth").alias("top_depth"), F.xxhash64(*KEY).alias("shard")
    )
    placed = shared.join(tops, "conv_id").withColumns(
        {"top": F.col("depth") == F.col("top_depth"), "shard": F.pmod("shard", F.lit(tasks * 8))}
    )
    # Uppermost nodes of the tails, for their parents.
    uppermost = tails.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("upper")).select("upper.*")
    ones = uppermost.filter("depth > 0").select("*", F.lit(1).alias("leaves"), F.lit(0).alias("saved"))
    light = written(_totals(_given(ones, placed), tasks, folder, queue_entries), "trie-light")
    roots = light.filter("top and depth > 0").select("depth", "p1", "p2", F.col("n_leaves").alias("leaves"), "saved")
    at_heavy = _given(ones.unionByName(roots), heavy).withColumns({"shard": F.lit(0), "top": F.col("depth") == 0})
    walked = _totals(at_heavy, 1, folder, queue_entries).unionByName(light).drop("p1", "p2", "top")
    inner = nodes.filter("n_convs > 1").join(walked, KEY)
    alone = tails.withColumns(
        {"n_children": 1 - F.col("n_ends"), "n_leaves": F.lit(1).cast("bigint"), "saved": F.lit(0).cast("bigint")}
    )
    every = inner.unionByName(alone.select(*inner.columns))

    def parents(of: DataFrame) -> DataFrame:
        return of.select(
            (F.col("depth") + 1).alias("depth"),
            F.col("k1").alias("p1"),
            F.col("k2").alias("p2"),
            F.col("conv_id").alias("parent_conv_id"),
        )

    # Parents with very many children are few enough to broadcast; the others have at most ``threshold``.
    up = ["depth", "p1", "p2"]
    every = written(every.join(F.broadcast(parents(heavy).withColumnRenamed("parent_conv_id", "upper")), up, "left"), "trie-every")
    found = every.filter("upper is not null").withColumn("parent_conv_id", F.col("upper"))
    others = every.filter("upper is null").join(parents(shared), up, "left")
    # What is left has a parent with one member, which is its own.
    own = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    others = others.withColumn("parent_conv_id", own)
    whole = found.unionByName(others.select(*found.columns)).join(_ends(rows, tasks), KEY, "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
