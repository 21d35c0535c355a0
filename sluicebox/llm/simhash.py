"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit for each bit of its shingles' XXH64 values, 1 if
set in over half of them. To find all fingerprints within ``distance`` bits, the
bits are cut into segments with radii that add up so that, of two such
fingerprints, at least one segment differs by no more than its radius
(pigeonhole). Each distinct fingerprint is filed once per segment; it probes
those tables with every value of the small Hamming ball around its own segment,
and the complete distance decides.

Texts are lower-cased in A-Z only; words are runs of other than space and the
controls 9 to 13. A text with fewer words than a shingle counts as one shingle;
null, empty and blank texts have the fingerprint zero and are linked like any
other. Equal fingerprints are one node, so copies make no pairs. A null
``doc_id`` keeps its row and never names a component unless no other id is there.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import written
from sluicebox.llm.components import components

BITS = 64
SEED = 42
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Shingles whose bits are counted at once.
STEP = 1 << 15


def shingle_hashes(text: str | None, words_per_shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a whole text, in order, repeats included."""
    import xxhash

    # Lower-casing bytes touches A-Z only.
    words = _WORDS.findall((text or "").encode("utf-8", "replace").lower())
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        yield np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
        return
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - words_per_shingle + 1].tolist()
    stops = (ends[words_per_shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        pairs = zip(starts[at : at + STEP], stops[at : at + STEP], strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)


def majority_bits(counts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint words (signed 64-bit) from counts per bit."""
    return np.packbits(2 * counts > n, bitorder="little").view("<i8")


def fingerprint(text: str | None, words_per_shingle: int, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words_per_shingle, seed):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(majority_bits(counts, n)[0]) if n else 0


def with_fingerprint(
    docs: DataFrame,
    words_per_shingle: int,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint`` (signed 64-bit) of each row, a map over Arrow batches."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = [fingerprint(t, words_per_shingle, seed) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).cast(pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"]
                )

    return docs.select(id_column, text_column).mapInArrow(run, "doc_id bigint, fingerprint bigint")


def plan_segments(distance: int, segments: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """``shift, width, radius`` per segment.

    If every segment differed by more than its radius, the whole would differ by
    at least the sum of (radius + 1) bits; that sum is made just above
    ``distance``. Later segments get the smaller radii and the spare width; a
    segment of radius -1 is not needed.
    """
    if not 0 <= distance < bits or not 1 <= segments <= bits:
        raise ValueError("distance and segments must fit the fingerprint")
    base, more = divmod(distance + 1, segments)
    width, spare = divmod(bits, segments)
    out, shift = [], 0
    for k in range(segments):
        size = width + (k >= segments - spare)
        out.append((shift, size, base + (k < more) - 1))
        shift += size
    return out


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` bits."""
    masks, layer = [0], [(0, -1)]
    for _ in range(max(0, radius)):
        layer = [(m | 1 << k, k) for m, last in layer for k in range(last + 1, width)]
        masks += [m for m, _ in layer]
    return masks if radius >= 0 else []


def _part(fingerprint: Column, shift: int, width: int) -> Column:
    moved = F.shiftrightunsigned(fingerprint, shift)
    return moved if width == BITS else moved.bitwiseAND((1 << width) - 1)


def near_pairs(
    nodes: DataFrame, distance: int, segments: int = 3, apart: Sequence[str] = ()
) -> DataFrame:
    """``a, b``: each pair of distinct ``fingerprint`` values at most ``distance`` bits apart, ``a < b``.

    ``nodes`` has one row per fingerprint. Pairs with equal values in a column of
    ``apart`` are left out (they are known to be linked). A pair comes out once:
    of the segments that find it only the first reports it.
    """
    plan = [(k, *s) for k, s in enumerate(plan_segments(distance, segments)) if s[2] >= 0]
    mark = F.col("fingerprint")
    extra = [F.col(c) for c in apart]

    def key(segment: int, value: Column) -> Column:
        return F.shiftleft(value, 4).bitwiseOR(F.lit(segment))

    def tried(k: int, shift: int, width: int, radius: int) -> Column:
        masks = F.array(*[F.lit(m).cast("bigint") for m in ball(width, radius)])
        return F.transform(masks, lambda m: key(k, _part(mark, shift, width).bitwiseXOR(m)))

    filed = nodes.select(
        mark.alias("b"),
        *[c.alias(f"_b_{n}") for c, n in zip(extra, apart, strict=True)],
        F.explode(F.array(*[key(k, _part(mark, shift, width)) for k, shift, width, _ in plan])).alias("key"),
    )
    probes = nodes.select(
        mark.alias("a"),
        *[c.alias(f"_a_{n}") for c, n in zip(extra, apart, strict=True)],
        F.explode(F.concat(*[tried(*part) for part in plan])).alias("key"),
    )
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # The first segment within its radius, for the pair as a whole.
    first = F.coalesce(
        *[F.when(F.bit_count(_part(differ, shift, width)) <= radius, F.lit(k)) for k, shift, width, radius in plan]
    )
    condition = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance)
    condition &= F.col("key").bitwiseAND(15) == first
    for n in apart:
        condition &= F.col(f"_a_{n}") != F.col(f"_b_{n}")
    return probes.join(filed, "key").filter(condition).select("a", "b")


def cluster(fingerprints: DataFrame, distance: int, segments: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest id reachable by links of ``distance`` bits.

    In a dense group nearly all fingerprints are linked with each other. A first
    round with three bits less joins most of a group; the whole distance is then
    asked for between different components only, so the pairs that come out do
    not grow with the square of such a group.
    """
    marks = written(fingerprints, "fingerprints")
    nodes = written(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    nearer = max(0, distance - 3)
    near = components(near_pairs(nodes, nearer, 2 if nearer < 2 else 3), "near-components")
    labelled = written(
        nodes.join(near.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
            "fingerprint", "least", F.coalesce("component", "fingerprint").alias("part")
        ),
        "fingerprint-parts",
    )
    parts = labelled.select(F.col("fingerprint").alias("a"), F.col("part").alias("b"))
    links = near_pairs(labelled, distance, segments, apart=["part"]).unionByName(parts.filter("a != b"))
    whole = components(links, "simhash-components").withColumnRenamed("node", "fingerprint")
    grouped = labelled.join(whole, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    grouped = written(grouped, "fingerprint-components")
    named = grouped.join(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    return marks.join(named.select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def hex_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def one_of_each_group(
    docs: DataFrame, words_per_shingle: int = 5, distance: int = 7, segments: int = 4
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; rows that share that id all stay.

    Seven bits are where near copies (five words, similarity 0.8 and over) part
    from texts that only share passages; the README has the shares found.
    """
    marks = with_fingerprint(docs, words_per_shingle)
    keep = cluster(marks, distance, segments).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = keep.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
