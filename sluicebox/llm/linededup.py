"""Line deduplication by a segment-partition edit join.

Two lines are near if at most ``distance`` (2) insertions, deletions and
substitutions of code points turn one into the other. A line is cut into
``distance + 1`` segments; of two near lines, some segment of the shorter stands
unchanged in the longer, at a place that their lengths narrow down. Each distinct
line is filed under its segments with its length, and probes the lengths up to
``distance`` shorter with the substrings that can matter (multi-match aware
selection). Lines that these segments leave open meet by two of ``distance + 2``
segments, which near lines have in common, too. Matches are told apart first by the parity of their characters (an
edit changes at most two of 64 parities), then by banded bit-parallel edit
distance on what is left between common ends.

An occurrence of a line is removed if an equal or near line stands earlier, by
``doc_id``, then text hash, then line number. Nearness is not carried on: a line
near to a removed one counts as repeated all the same. Lines with fewer than
``least_chars`` code points are near to none: two edits say little about them.
With ``short_equal`` those that are not blank are removed if an equal line
stands earlier, else they are left alone.

Null and empty texts have no lines to remove. Rows that repeat an id and its text
are one document and get the same answer. A null id comes first. Extra columns
stay as they are in ``without_repeated_lines`` and are not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_rows, tasks_for, written

DISTANCE = 2
LEAST_CHARS = 20
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)
#: A short line of nothing else is blank.
BLANKS = " \t\n\v\f\r"
#: Candidate ids are broadcast up to this many (16 bytes each), joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Lines of one side that a task compares at most with as many of the other, for one segment.
CELL_LINES = 2048
#: Lengths of lines whose cuts a worker remembers.
CACHED_LENGTHS, CACHED_FINE_LENGTHS = 4096, 512
#: Rounds against the earliest open line of a segment go on while the open pairs are more than
#: this many per row, and while a round settles at least one of so many open lines.
PAIRS_PER_ROW, LEAST_SETTLED = 8, 16
#: Rows of a batch that goes on to the next step.
BATCH_ROWS = 8192


def line_ids(line: str) -> tuple[int, int]:
    """Two signed 64-bit halves of the line's 128-bit hash."""
    import xxhash

    digest = xxhash.xxh3_128_intdigest(line.encode("utf-8", "replace"))
    return _signed(digest >> 64), _signed(digest & (1 << 64) - 1)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def segments(length: int, distance: int) -> list[tuple[int, int]]:
    """``start, size`` of the segments of a line of ``length`` characters; longer ones last."""
    parts = distance + 1
    size, longer = divmod(length, parts)
    out, start = [], 0
    for k in range(parts):
        own = size + (k >= parts - longer)
        out.append((start, own))
        start += own
    return out


def places(length: int, other: int, distance: int) -> Iterator[tuple[int, int, int]]:
    """``segment, start, size`` of the substrings of a line of ``length`` to look up among lines of ``other``.

    ``other`` is at most ``length``. For segment k (from 0) an edit script that
    leaves it unchanged spends at most k edits before it and at most
    ``distance - k`` behind it, which bounds the shift from both ends.
    """
    more = length - other
    for k, (start, size) in enumerate(segments(other, distance)):
        low = max(start - k, start + more - (distance - k), 0)
        high = min(start + k, start + more + (distance - k), length - size)
        for at in range(low, high + 1):
            yield k, at, size


@lru_cache(maxsize=CACHED_LENGTHS)
def cuts(length: int, distance: int, least_chars: int) -> tuple[tuple[bool, int, int, int], ...]:
    """``filed, seed, from, to`` of all substrings that a line of ``length`` files or looks up, each once.

    Places are in bytes of four per character; the seed of a substring's hash
    tells apart lengths of lines and segments. What a line files it looks up too,
    among lines of its own length.
    """
    own = {(length * (distance + 1) + k, 4 * at, 4 * (at + size)) for k, (at, size) in enumerate(segments(length, distance))}
    tried = {
        (other * (distance + 1) + k, 4 * at, 4 * (at + size))
        for other in range(max(least_chars, length - distance), length + 1)
        for k, at, size in places(length, other, distance)
    }
    return tuple((cut in own, *cut) for cut in sorted(own | tried))


@lru_cache(maxsize=CACHED_LENGTHS)
def are_filed(length: int, distance: int, least_chars: int) -> np.ndarray:
    """Which of the ``cuts`` are filed."""
    return np.array([filed for filed, *_ in cuts(length, distance, least_chars)])


@lru_cache(maxsize=CACHED_FINE_LENGTHS)
def fine_cuts(length: int, distance: int, least_chars: int) -> tuple[tuple[bool, int, int, int, int, int], ...]:
    """``filed, seed, from, to, from, to`` of pairs of substrings, as ``cuts`` has single ones.

    Of ``distance + 2`` segments of the shorter line ``distance`` edits leave two
    unchanged. The shifts of these two and the difference of the lengths show how
    many edits stand before, between and behind them at least.
    """
    parts = distance + 2
    pairs = [(i, j) for i in range(parts) for j in range(i + 1, parts)]
    out = {}
    for other in range(max(least_chars, length - distance), length + 1):
        more = length - other
        cut = segments(other, distance + 1)
        for n, (i, j) in enumerate(pairs):
            seed = other * len(pairs) + n
            for a in range(-distance, distance + 1):
                for b in range(-distance, distance + 1):
                    if abs(a) + abs(b - a) + abs(more - b) > distance:
                        continue
                    ends = [e for (start, size), shift in ((cut[i], a), (cut[j], b)) for e in (start + shift, start + shift + size)]
                    if ends[0] >= 0 and ends[2] >= 0 and ends[1] <= length and ends[3] <= length:
                        place = (seed, *[4 * e for e in ends])
                        out[place] = out.get(place, False) or more == a == b == 0
    return tuple((filed, *place) for place, filed in sorted(out.items()))


def parity(line: str) -> int:
    """A bit for each of 64 character classes: whether the class occurs an odd number of times."""
    codes = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32) & 63
    return int(np.packbits(np.bincount(codes, minlength=64) & 1, bitorder="little").view("<i8")[0])


def within(a: str, b: str, distance: int) -> int | None:
    """Edit distance of ``a`` and ``b`` if at most ``distance``, by banded bit-parallel columns.

    Common ends cost nothing and are cut off first. Of each column only the cells
    about the diagonal are held, as bits of rising and falling vertical steps in
    a word of ``2 * distance + 2`` bits that moves down a row per character.
    """
    if abs(len(a) - len(b)) > distance:
        return None
    if len(a) > len(b):
        a, b = b, a
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m = len(a)
    if m == 0:
        return len(b) if len(b) <= distance else None
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    width = 2 * distance + 2
    word, top = (1 << width) - 1, 1 << (width - 1)
    # The top bit of column j stands for row j + distance; rows above the first have no step.
    plus, minus = word & ~(word >> (distance + 1)), 0
    score = min(distance, m)
    last = top >> 1 >> max(0, distance - m)
    shift = distance + 1 - width
    for j, c in enumerate(b):
        at = where.get(c, 0)
        equal = (at << -(shift + j) if shift + j < 0 else at >> (shift + j)) & word
        d0 = ((((equal & plus) + plus) ^ plus) | equal | minus) & word
        h_plus = (minus | ~(d0 | plus)) & word
        h_minus = d0 & plus
        if j < m - distance:
            # Down the diagonal, until the band's lower edge meets the last row ...
            score += not d0 & top
        else:
            # ... and along that row from there.
            score += bool(h_plus & last) - bool(h_minus & last)
            last >>= 1
        plus = (h_minus | ~(d0 >> 1 | h_plus)) & word
        minus = d0 >> 1 & h_plus
    return score if score <= distance else None


def _lines(row: dict, least_chars: int, short: bool = False) -> Iterator[tuple[int, str]]:
    for number, line in enumerate((row["text"] or "").split("\n")):
        if len(line) >= least_chars or short and line.strip(BLANKS):
            yield number, line


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS, short_equal: bool = False) -> DataFrame:
    """``doc_id, text_hash, line_no, h1, h2`` of every line that can be removed; no text is carried."""

    def run(batches):
        from xxhash import xxh3_128_digest

        doc_ids: list[int | None] = []
        hashes: list[int] = []
        numbers: list[int] = []
        digests: list[bytes] = []

        def out() -> pa.RecordBatch:
            # A digest is big-endian, its high half first, as in line_ids.
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(hashes, pa.int64()),
                    pa.array(numbers, pa.int32()),
                    pa.array(halves[:, 0].copy()),
                    pa.array(halves[:, 1].copy()),
                ],
                names=["doc_id", "text_hash", "line_no", "h1", "h2"],
            )
            doc_ids.clear(), hashes.clear(), numbers.clear(), digests.clear()
            return made

        for row in _rows(batches):
            before = len(numbers)
            for number, line in _lines(row, least_chars, short_equal):
                numbers.append(number)
                digests.append(xxh3_128_digest(line.encode("utf-8", "replace")))
            doc_ids += [row["doc_id"]] * (len(numbers) - before)
            hashes += [row["text_hash"]] * (len(numbers) - before)
            if len(numbers) >= BATCH_ROWS:
                yield out()
        if numbers:
            yield out()

    return _keyed(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, line_no int, h1 bigint, h2 bigint")


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")


def segment_rows(docs: DataFrame, distance: int = DISTANCE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``key, filed, id, odd, doc`` of each line and each of its cuts.

    ``id`` is the first half of the line's hash, ``odd`` its parity and ``doc`` the
    smallest id of a document that has it (null: below all).
    """
    if least_chars <= distance:
        raise ValueError("a line must be longer than the distance")

    def run(batches):
        from xxhash import xxh3_64_intdigest as digest

        seen: dict[int, int] = {}
        keys: list[int] = []
        lines: list[tuple[int, int, int, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, odds, doc_ids, filed = zip(*lines, strict=True)
            n = [len(f) for f in filed]
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array(np.concatenate(filed)),
                    *[pa.array(np.repeat(np.array(v, np.int64), n)) for v in (ids, odds, doc_ids)],
                ],
                names=["key", "filed", "id", "odd", "doc"],
            )
            keys.clear(), lines.clear()
            return made

        for row in _rows(batches):
            doc = NO_ID if row["doc_id"] is None else row["doc_id"]
            for _, line in _lines(row, least_chars):
                own = line_ids(line)[0]
                if seen.get(own, doc + 1) <= doc:
                    continue
                # Only spares work: repeats from other tasks are grouped away below.
                if len(seen) >= 200_000:
                    seen.clear()
                seen[own] = doc
                codes = line.encode("utf-32-le", "replace")
                keys += [digest(codes[a:b], seed) for _, seed, a, b in cuts(len(line), distance, least_chars)]
                lines.append((own, parity(line), doc, are_filed(len(line), distance, least_chars)))
                if len(keys) >= BATCH_ROWS:
                    yield out()
        if lines:
            yield out()

    slim = docs.select(F.col("doc_id").cast("bigint"), "text")
    return slim.mapInArrow(run, "key bigint, filed boolean, id bigint, odd bigint, doc bigint")


def shared_keys(rows: DataFrame, tasks: int) -> DataFrame:
    """``key, filed, id, odd, doc, first, first_odd, only``: lines of ``segment_rows`` that meet others in a key.

    ``first`` is the earliest line that is filed there; ``only`` if every pair of
    the key is a pair with it, as it is the only one filed or has one partner.
    """
    # Dealt by key once and read twice from the same exchange, so both readers want every column. Few of the
    # keys have lines that meet: these are found by numbers alone, without a sort, and only their rows go on.
    rows = rows.repartition(tasks, "key")
    ends = rows.groupBy("key").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.max("filed").alias("any"), F.expr("count(odd, doc)").alias("n")
    )
    several = ends.filter("n > 1 AND low < high AND any").select("key")
    meeting = rows.join(several.hint("shuffle_hash"), "key").repartition(tasks, "key", "id")
    meeting = meeting.groupBy("key", "id").agg(
        F.max("filed").alias("filed"), F.max("odd").alias("odd"), F.min("doc").alias("doc")
    )
    by_key = meeting.groupBy("key").agg(
        F.min(F.when(F.col("filed"), F.struct("doc", "id", "odd"))).alias("e"),
        F.count(F.when(F.col("filed"), 1)).alias("n_filed"),
        F.count("*").alias("n"),
    )
    firsts = by_key.select(
        "key", F.col("e.id").alias("first"), F.col("e.odd").alias("first_odd"), ((F.col("n_filed") == 1) | (F.col("n") == 2)).alias("only")
    )
    return meeting.join(firsts, "key")


def _fits(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2 * distance


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def with_first(shared: DataFrame, distance: int) -> DataFrame:
    """``a, b`` (``a < b``): each line with the first one of each of its keys."""
    fit = shared.filter((F.col("id") != F.col("first")) & _fits("odd", "first_odd", distance))
    return fit.select(*_pairs(F.col("id"), F.col("first"))).distinct()


def open_pairs(shared: DataFrame, open_lines: DataFrame, distance: int, tasks: int, cell: int = CELL_LINES) -> DataFrame:
    """``a, b``: each of ``open_lines`` (``id``) with the lines of its keys that may stand earlier, without the firsts.

    A key with more than ``cell`` times ``cell`` pairs is cut into a grid: each
    side is dealt into parts of about ``cell`` lines, each part of one meets each
    of the other in a place of its own, and places are spread over all tasks.
    """
    rest = shared.filter((F.col("id") != F.col("first")) & ~F.col("only"))
    others = rest.select("key", *[F.col(c).alias(f"f_{c}") for c in ("id", "odd", "doc", "filed")])
    asking = written(rest.join(open_lines, "id", "left_semi"), "line-asking")
    counts = (
        rest.groupBy("key").agg(F.count("*").alias("n_rows"))
        .join(asking.groupBy("key").agg(F.count("*").alias("n_open")), "key")
    )
    parts = [F.ceil(F.col(n) / cell).cast("int").alias(s) for n, s in (("n_rows", "rows"), ("n_open", "columns"))]
    hot = counts.filter(F.col("n_rows") * F.col("n_open") > cell * cell).select("key", *parts)
    asking = asking.select("key", *[F.col(c).alias(f"p_{c}") for c in ("id", "odd", "doc", "filed")])

    def place(side: str, own: str, other: str) -> list[Column]:
        part = F.pmod(F.xxhash64(side), F.col(own)).cast("int").alias(f"own_{own}")
        return ["*", part, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"own_{other}")]

    grid = ["key", "own_rows", "own_columns"]
    wide = others.join(hot, "key").select(*place("f_id", "rows", "columns")).drop("rows", "columns")
    tall = asking.join(hot, "key").select(*place("p_id", "columns", "rows")).drop("rows", "columns")
    hot_pairs = tall.repartition(tasks, *grid).join(wide.repartition(tasks, *grid), grid).drop(*grid)
    cold_pairs = asking.join(hot, "key", "left_anti").join(others, "key").drop("key")
    wanted = (F.col("f_id") != F.col("p_id")) & (F.col("f_doc") <= F.col("p_doc")) & (F.col("f_filed") | F.col("p_filed"))
    both = cold_pairs.unionByName(hot_pairs).filter(wanted & _fits("f_odd", "p_odd", distance))
    return both.select(*_pairs(F.col("f_id"), F.col("p_id"))).distinct()


def next_round(asking: DataFrame) -> DataFrame:
    """``asking`` with ``first, first_odd`` of each key: the earliest of its open lines that was not its first before."""
    rest = asking.filter("NOT told")
    by_key = rest.groupBy("key").agg(
        F.min(F.when(F.col("filed"), F.struct("doc", "id", "odd"))).alias("e"), F.count("*").alias("n")
    )
    several = by_key.filter("n > 1 AND e IS NOT NULL").select(
        "key", F.col("e.id").alias("first"), F.col("e.odd").alias("first_odd")
    )
    return rest.join(several, "key")


def still_open(asking: DataFrame, late: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The rows of ``asking`` without the lines that are ``late``; what was ``asked`` as a first is ``told``."""
    rest = asking.join(late.select(F.col("h1").alias("id")), "id", "left_anti")
    if asked is not None:
        firsts = asked.filter("id = first").select("key", "id", F.lit(True).alias("now"))
        rest = rest.join(firsts, ["key", "id"], "left").withColumn("told", F.col("told") | F.col("now").isNotNull()).drop("now")
    return written(rest, "line-open")


def _texts(docs: DataFrame, wanted: DataFrame, firsts: DataFrame, least_chars: int) -> DataFrame:
    """``h1, h2, line, first`` of the lines whose ``h1`` is in ``wanted``."""
    small = wanted.count() <= BROADCAST_IDS

    def make():
        def each(row):
            for _, line in _lines(row, least_chars):
                h1, h2 = line_ids(line)
                yield h1, h2, line

        return each

    lines = map_rows(docs.select("text"), make, "h1 bigint, h2 bigint, line string", 1024)
    lines = lines.join(F.broadcast(wanted) if small else wanted, "h1", "left_semi").dropDuplicates(["h1", "h2"])
    return written(lines.join(firsts, ["h1", "h2"]), "candidate-lines")


def fine_rows(lines: DataFrame, distance: int, least_chars: int) -> DataFrame:
    """As ``segment_rows``, of ``lines`` (``h1, line, first``) by two segments at a time."""

    def make():
        from xxhash import xxh3_64_intdigest as digest

        def each(row):
            line, doc = row["line"], NO_ID if row["doc"] is None else row["doc"]
            codes, odd = line.encode("utf-32-le", "replace"), parity(line)
            for filed, seed, a, b, c, d in fine_cuts(len(line), distance, least_chars):
                yield _signed(digest(codes[a:b] + codes[c:d], seed)), filed, row["h1"], odd, doc

        return each

    slim = lines.select("h1", "line", F.col("first.doc_id").alias("doc"))
    return map_rows(slim, make, "key bigint, filed boolean, id bigint, odd bigint, doc bigint", BATCH_ROWS)


def _open(rest: DataFrame, late: DataFrame) -> DataFrame:
    ids = rest.select("id").distinct()
    return written(ids.join(late.select(F.col("h1").alias("id")), "id", "left_anti"), "line-open")


def _late(pairs: DataFrame, lines: DataFrame, distance: int) -> DataFrame:
    """``h1, h2``: the later line of each of ``pairs`` that is at most ``distance`` edits long."""

    def side(name: str) -> DataFrame:
        return lines.select(*[F.col(c).alias(n) for c, n in (("h1", name), ("h2", f"{name}2"))], *[
            F.col(c).alias(f"{name}_{c}") for c in ("line", "first")
        ])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("later", F.col("a_first") > F.col("b_first")).drop("a_first", "b_first")

    def check():
        def each(row):
            if within(row["a_line"], row["b_line"], distance) is not None:
                yield (row["a"], row["a2"]) if row["later"] else (row["b"], row["b2"])

        return each

    return map_rows(both, check, "h1 bigint, h2 bigint", 4096).distinct()


def late_lines(
    docs: DataFrame, firsts: DataFrame, distance: int = DISTANCE, least_chars: int = LEAST_CHARS, cell: int = CELL_LINES
) -> DataFrame:
    """``h1, h2`` of every line with a near one whose ``first`` place is earlier.

    A line only has to know whether there is one. So it is compared with the
    earliest line of each of its keys first, which is one pair per row and settles
    most of a group of near lines. Lines that are open still meet by two of
    ``distance + 2`` segments from there on, so that a passage that many lines share
    makes no pairs of them all. Further rounds do so among the lines that are
    open still, while that settles many. The last round asks for the open lines
    alone, against all earlier lines of their keys, open or not: nothing is lost.
    """
    tasks = tasks_for(docs)
    shared = written(shared_keys(segment_rows(docs, distance, least_chars), tasks), "line-keys")
    pairs = written(with_first(shared, distance), "line-pairs")
    rest = shared.filter("NOT only")
    wanted = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).union(rest.select("id")).distinct()
    lines = _texts(docs, wanted, firsts, least_chars)
    every = written(_late(pairs, lines, distance), "line-late")
    open_lines = _open(rest, every)
    if open_lines.isEmpty():
        return every
    # Lines that have but one segment in common part here: the open ones and those of their keys go on.
    keys = rest.join(open_lines, "id").select("key").distinct()
    ids = rest.join(keys, "key", "left_semi").select(F.col("id").alias("h1")).distinct()
    fine = fine_rows(lines.join(ids, "h1", "left_semi"), distance, least_chars)
    shared = written(shared_keys(fine, tasks), "line-keys")
    late = written(_late(with_first(shared, distance), lines, distance), "line-late")
    every = written(every.union(late).distinct(), "line-late")
    # The firsts have been compared with all lines of their keys. From round to round only rows of lines that
    # are open go on, so each round reads what the one before has left, once.
    rest = shared.filter((F.col("id") != F.col("first")) & ~F.col("only"))
    per_key = written(rest.groupBy("key").agg(F.count("*").alias("n")), "line-counts")
    rows = per_key.agg(F.sum("n")).first()[0] or 0
    asking = still_open(rest.select("key", "filed", "id", "odd", "doc", F.lit(False).alias("told")), every)
    before = None
    while True:
        open_lines = asking.select("id").distinct()
        n_open = open_lines.count()
        if n_open == 0:
            return every
        open_per_key = asking.groupBy("key").agg(F.count("*").alias("m"))
        left = per_key.join(open_per_key, "key").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
        if left <= PAIRS_PER_ROW * rows or before is not None and (before - n_open) * LEAST_SETTLED < before:
            break
        before = n_open
        asked = written(next_round(asking), "line-keys")
        late = written(_late(with_first(asked, distance), lines, distance), "line-late")
        every = every.union(late).distinct()
        asking = still_open(asking, late, asked)
    last = written(open_pairs(shared, open_lines, distance, tasks, cell), "line-pairs")
    return every.union(_late(last, lines, distance)).distinct()


def repeated_lines(
    docs: DataFrame, distance: int = DISTANCE, least_chars: int = LEAST_CHARS, short_equal: bool = False
) -> DataFrame:
    """``doc_id, text_hash, line_no, near``: the occurrences to remove; ``near`` if no equal line stands earlier."""
    found = written(occurrences(docs, least_chars, short_equal), "line-occurrences")
    place = F.struct("doc_id", "text_hash", "line_no")
    firsts = written(found.groupBy("h1", "h2").agg(F.min(place).alias("first")), "line-firsts")
    late = written(late_lines(docs, firsts, distance, least_chars), "line-late").withColumn("late", F.lit(True))
    state = firsts.join(late, ["h1", "h2"], "left")
    joined = found.join(state, ["h1", "h2"]).withColumn("is_first", place.eqNullSafe(F.col("first")))
    return joined.filter("late or not is_first").select(
        "doc_id", "text_hash", "line_no", F.col("is_first").alias("near")
    )


def _removed(docs: DataFrame, distance: int, least_chars: int, short_equal: bool) -> DataFrame:
    repeated = repeated_lines(docs, distance, least_chars, short_equal).distinct()
    return repeated.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list("line_no")).alias("removed"),
        F.count(F.when(F.col("near"), 1)).alias("n_near"),
    )


def line_report(
    docs: DataFrame, distance: int = DISTANCE, least_chars: int = LEAST_CHARS, short_equal: bool = False
) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_near, removed`` (line numbers from 0) of each row, no text shuffled."""
    slim = docs.select(
        "doc_id",
        F.xxhash64("text").alias("_own"),
        F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("bigint").alias("n_lines"),
    )
    gone = _removed(docs, distance, least_chars, short_equal)
    same = slim["doc_id"].cast("bigint").eqNullSafe(gone["doc_id"]) & (slim["_own"] == gone["text_hash"])
    return slim.join(gone, same, "left").select(
        slim["doc_id"],
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def without_repeated_lines(
    docs: DataFrame, distance: int = DISTANCE, least_chars: int = LEAST_CHARS, short_equal: bool = False
) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; every row stays, maybe with an empty text."""
    # The row travels as one value, so no column of it can be taken for another.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("own_id"),
        F.xxhash64("text").alias("own_hash"),
    )
    gone = _removed(docs.select("doc_id", "text"), distance, least_chars, short_equal)
    # A null text has the hash of nothing; both keys may be null, so equality is null-safe.
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    joined = rows.join(gone.select("doc_id", "text_hash", "removed"), same, "left")
    kept = F.expr(
        "array_join(transform(filter(transform(split(row.text, '\\n'), (x, i) -> named_struct('x', x, 'i', i)), "
        "y -> NOT array_contains(removed, y.i)), y -> y.x), '\\n')"
    )
    text = F.when(F.size("removed") > 0, kept).otherwise(F.col("row.text"))
    return joined.select(*[(text if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
