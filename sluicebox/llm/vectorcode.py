"""Product codes of vectors by an exact integer Lloyd iteration that looks at moved entries only.

Components become integers, ``floor(scale * x)``; a vector is cut into equal
consecutive parts, and each part position has a codebook of its own. A codebook
starts as that part of the smallest kept ids. A round gives every part its
nearest entry (squared Euclidean distance, ties to the lower index) and then
replaces each used entry by the componentwise ``floor(sum / count)`` of its
parts. After the rounds the parts are given their entries once more.

Between rounds each vector keeps its entries and their exact distances. Where a
part's entry did not move in the last update, no unmoved entry can have become
nearer: only the moved entries are compared with the kept distance. Where it
moved, the whole codebook is looked at. Both give the same answer as a whole
look, ties included.

Everything is integer arithmetic in tasks. A distance is worked out in float32
or float64 matrix products only where all intermediate sums are whole numbers
that the type holds exactly, else in int64. The driver holds the codebooks and
one sum per entry and component; both have a size that does not depend on the
table. Vectors of a state table are stored as the smallest integers that fit.

Rows whose vector is null or holds a null, NaN or infinite component are dropped.
So are vectors of another length than most kept ones have (ties: the longer), as
no distance to them is defined. Components so large that an error would not fit a
long raise ``ValueError``. If the length is no multiple of the number of parts,
the first parts are one longer. Ties on the id among the first entries go to the
smaller vector, by components; null ids come last. Repeated rows each get their
code. With fewer rows than entries, codebooks are that much smaller; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are compared at once.
STEP = 2048
#: Distinct labels up to which their sums are broadcast (16 bytes each); beyond, rows are salted.
BROADCAST_LABELS, SALTS = 200_000, 32

STATE = "vec_id bigint, label string, width int, vector binary, codes binary, errors binary"


@dataclass(frozen=True)
class Codebooks:
    """The entries of every part position (entries x components), and which moved in the last update."""

    entries: list[np.ndarray]
    moved: list[np.ndarray]

    def text_hash(self) -> str:
        numbers = [str(v) for part in self.entries for v in part.reshape(-1).tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def part_edges(dims: int, parts: int) -> list[int]:
    size, longer = divmod(dims, parts)
    return np.cumsum([0] + [size + (k < longer) for k in range(parts)]).tolist()


def _exact_type(values: np.ndarray, entries: np.ndarray) -> type:
    """The fastest type that holds every sum of a distance between the two exactly."""
    dims = max(1, entries.shape[1])
    most = max(int(np.abs(values).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = 4 * dims * most * most
    if bound < 1 << 24:
        return np.float32
    return np.float64 if bound < 1 << 53 else np.int64


def distances(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x entries."""
    kind = _exact_type(values, entries)
    v, e = values.astype(kind), entries.astype(kind)
    out = v @ e.T
    out *= -2
    out += (e * e).sum(axis=1)
    out += (v * v).sum(axis=1)[:, None]
    return out.astype(np.int64)


def assign(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties: lower index) and its distance, by a whole look."""
    found = distances(values, entries)
    code = found.argmin(axis=1)
    return code, found[np.arange(len(found)), code]


def reassign(
    values: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, error: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The same after an update of which ``moved`` tells the changed entries, from the entries and distances before."""
    code, error = code.astype(np.int64), error.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return code, error
    lost = moved[code]
    stayed = np.flatnonzero(~lost)
    if len(stayed):
        found = distances(values[stayed], entries[active])
        best = found.argmin(axis=1)
        new, at = active[best], found[np.arange(len(stayed)), best]
        old, kept = code[stayed], error[stayed]
        nearer = (at < kept) | ((at == kept) & (new < old))
        code[stayed], error[stayed] = np.where(nearer, new, old), np.where(nearer, at, kept)
    if lost.any():
        code[lost], error[lost] = assign(values[lost], entries)
    return code, error


def _packed(values: np.ndarray) -> list[bytes]:
    """Each row in the smallest signed integers that hold the whole batch."""
    most = int(np.abs(values).max(initial=0))
    kind = "<i1" if most < 128 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return [row.tobytes() for row in values.astype(kind)]


def _unpacked(rows: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers, each row packed in a width of its own."""
    out = np.zeros((len(rows), dims), np.int64)
    sizes = pc.binary_length(rows).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        data = b"".join(rows.take(pa.array(some)).to_pylist())
        if dims:
            out[some] = np.frombuffer(data, f"<i{size // dims}").reshape(-1, dims)
    return out


def _usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str | None) -> DataFrame:
    """``vec_id, label, vector`` (doubles) of the rows that can be coded."""
    label = F.col(label_column).cast("string") if label_column else F.lit(None).cast("string")
    picked = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        label.alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return picked.filter(F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _integers(column: pa.ListArray, dims: int, scale: int, largest: float) -> np.ndarray:
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if np.abs(flat).max(initial=0) > largest:
        raise ValueError(f"components beyond {largest / scale:g} do not fit an exact error")
    return flat.astype(np.int64).reshape(-1, dims)


def _first_assignment(usable: DataFrame, books: Codebooks, dims: int, scale: int, largest: float) -> DataFrame:
    edges = part_edges(dims, len(books.entries))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                values = _integers(some.column(2), dims, scale, largest)
                found = [assign(values[:, a:b], e) for a, b, e in zip(edges, edges[1:], books.entries, strict=False)]
                yield _state(some.column(0), some.column(1), dims, _packed(values), found)

    # Values of one length only, so a batch is a matrix.
    return usable.filter(F.size("vector") == dims).mapInArrow(run, STATE)


def _state(ids, labels, dims: int, vectors: list[bytes], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
    errors = np.stack([e for _, e in found], axis=1)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            labels,
            pa.array([dims] * len(ids), pa.int32()),
            pa.array(vectors, pa.binary()),
            pa.array([row.tobytes() for row in codes], pa.binary()),
            pa.array(_packed(errors), pa.binary()),
        ],
        names=["vec_id", "label", "width", "vector", "codes", "errors"],
    )


def _states(batches, parts: int):
    """``batch, values, codes, errors`` of a state table, a few thousand vectors at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            some = batch.slice(at, STEP)
            if some.num_rows:
                codes = np.frombuffer(b"".join(some.column(4).to_pylist()), np.uint8).reshape(-1, parts)
                values = _unpacked(some.column(3), some.column(2)[0].as_py())
                yield some, values, codes, _unpacked(some.column(5), parts)


def _next_assignment(state: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    parts = len(books.entries)
    edges = part_edges(dims, parts)

    def run(batches):
        for some, values, codes, errors in _states(batches, parts):
            found = [
                reassign(values[:, edges[k] : edges[k + 1]], books.entries[k], books.moved[k], codes[:, k], errors[:, k])
                for k in range(parts)
            ]
            yield _state(some.column(0), some.column(1), dims, some.column(3).to_pylist(), found)

    return state.mapInArrow(run, STATE)


def _updated(state: DataFrame, books: Codebooks, dims: int) -> Codebooks:
    """Entries after one update. A task adds up its own vectors, so at most one row per entry and
    component leaves it, and as many reach the driver, whatever the number of vectors."""
    parts, edges = len(books.entries), part_edges(dims, len(books.entries))
    entries = len(books.entries[0])

    def run(batches):
        sums = [np.zeros((entries, edges[k + 1] - edges[k]), np.int64) for k in range(parts)]
        counts = np.zeros((parts, entries), np.int64)
        for _, values, codes, _ in _states(batches, parts):
            for k in range(parts):
                counts[k] += np.bincount(codes[:, k], minlength=entries)
                np.add.at(sums[k], codes[:, k], values[:, edges[k] : edges[k + 1]])
        slots = np.flatnonzero(counts.reshape(-1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(1 + edges[s // entries + 1] - edges[s // entries], s) for s in slots]))
                if len(slots)
                else pa.array([], pa.int64()),
                pa.array([p for s in slots for p in range(-1, edges[s // entries + 1] - edges[s // entries])], pa.int64()),
                pa.array(
                    [v for s in slots for v in (counts[s // entries, s % entries], *sums[s // entries][s % entries])],
                    pa.int64(),
                ),
            ],
            names=["slot", "place", "total"],
        )

    found = state.mapInArrow(run, "slot bigint, place bigint, total bigint").groupBy("slot", "place")
    totals = {(r["slot"], r["place"]): r["total"] for r in found.agg(F.sum("total").alias("total")).collect()}
    new, moved = [], []
    for k, old in enumerate(books.entries):
        entry = old.copy()
        for e in range(entries):
            n = totals.get((k * entries + e, -1))
            if n:
                entry[e] = [totals[k * entries + e, p] // n for p in range(old.shape[1])]
        new.append(entry)
        moved.append((entry != old).any(axis=1))
    return Codebooks(new, moved)


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str | None = "label",
) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, codes`` (a byte per part), ``error`` of each kept row, and the final codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    spark = vectors.sparkSession
    usable = _usable(vectors, id_column, vector_column, label_column)
    # One row per length that occurs; the two best are enough.
    lengths = usable.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        empty = spark.createDataFrame([], "vec_id bigint, label string, codes binary, error bigint")
        return empty, Codebooks([np.zeros((0, 0), np.int64)] * parts, [np.zeros(0, bool)] * parts)
    dims = most["dims"]
    # Sums of all parts' squared distances stay below 2^62.
    largest = float(int((2**62 / max(1, dims)) ** 0.5 / 2))
    first = usable.filter(F.size("vector") == dims).orderBy(F.asc_nulls_last("vec_id"), "vector")
    seeds = first.select("vector").limit(entries).collect()
    start = _integers(pa.array([r["vector"] for r in seeds], pa.list_(pa.float64())), dims, scale, largest)
    edges = part_edges(dims, parts)
    cut = [start[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)]
    books = Codebooks(cut, [np.ones(len(start), bool)] * parts)
    state = written(_first_assignment(usable, books, dims, scale, largest), "vector-codes")
    for _ in range(rounds):
        books = _updated(state, books, dims)
        state = written(_next_assignment(state, books, dims), "vector-codes")

    def total(batches):
        for batch in batches:
            if batch.num_rows:
                sums = _unpacked(batch.column(3), parts).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
                    names=["vec_id", "label", "codes", "error"],
                )

    slim = state.select("vec_id", "label", "codes", "errors")
    return slim.mapInArrow(total, "vec_id bigint, label string, codes binary, error bigint"), books


def code_report(vectors: DataFrame, **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each kept row.

    ``code`` has two hex digits per part; ``label_error`` is the error of all rows
    with the same label, null counting as one.
    """
    coded, books = compress(vectors, **options)
    rows = written(coded, "vector-errors")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        own, other = rows.withColumn("salt", F.lit(0)), F.broadcast(sums.withColumn("salt", F.lit(0)))
    else:
        # A label may hold any share of the rows: they are dealt over salts that its one sum is copied to.
        own = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
        other = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own, other = own.alias("own"), other.alias("other")
    same = F.col("own.label").eqNullSafe(F.col("other.label")) & (F.col("own.salt") == F.col("other.salt"))
    return own.join(other, same).select(
        "own.vec_id",
        F.lower(F.hex("own.codes")).alias("code"),
        "own.error",
        "other.label_error",
        F.lit(books.text_hash()).alias("codebooks_sha256"),
    )
