"""Benchmark decontamination by templates, with DataFrame functions only.

A text becomes a template: names, numbers and units give way to typed
placeholders, punctuation goes, letters become small. A name is a capitalised
word behind a word that does not end a sentence; a unit is a word of a fixed list
behind a number. Windows of ``window`` (5) template words of documents and
benchmark items meet by hash. A window that is all placeholders tells nothing and
is left out on both sides; a text with fewer words is one window. With
``short_inside`` an item of fewer words is also looked for inside longer
documents, which then have windows of the lengths of such items as well.

Matches of a document and an item that lie on one diagonal (same distance of
places) have to agree on their slots: a value of the item must always stand for
the same value of the document. Diagonals that contradict themselves are
dropped. The share of the item's windows found in the rest is its coverage; from
``least_coverage`` (0.5) up the document holds the item, word for word or with
other numbers, names and units.

The windows of the items are broadcast while they are few, which is checked by
counting them, and are joined by a shuffle beyond; document windows without a
match go no further.

Null and empty texts hold nothing, on either side. Items with equal texts are all
reported. Documents are told apart by id and text, so rows that repeat both get
the same answer and a null id keeps its row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
LEAST_COVERAGE = 0.5
#: Item windows that are broadcast at most (about 100 bytes each).
BROADCAST_WINDOWS = 500_000

NAME, NUMBER, UNIT = "‹name›", "‹number›", "‹unit›"
# Words that count as units behind a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches feet foot yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds "
    "ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros "
    "degree degrees mph kmh kph kw kwh w v hz khz mhz ghz kb mb gb tb"
).split()

_SPACE = r"[\x20\x09-\x0D]"
# The capital is looked at first: few places have one, and what stands before is dearer to see.
_NAMES = r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;:]\x20)\p{Lu}\p{Ll}+"
_NUMBERS = r"[0-9]+(?:[.,][0-9]+)*"
# The number before a unit is taken along, which is put back.
_UNITS = rf"(?i)({NUMBER}\x20?)(?:(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])|[%€$£°])"
_MARKS = r"[^\p{L}\p{N}\x20\x09-\x0D‹›]+"


def _template(text: Column) -> Column:
    """The template of each piece of a text between two spaces, empty where nothing is left of it.

    No replacement takes or makes a space, so the pieces stay in their places.
    """
    named = F.regexp_replace(text, _NAMES, NAME)
    counted = F.regexp_replace(named, _NUMBERS, NUMBER)
    measured = F.regexp_replace(counted, _UNITS, f"$1{UNIT}")
    return F.split(F.lower(F.regexp_replace(measured, _MARKS, "")), _SPACE)


def _plain(text: Column) -> Column:
    """The same pieces with their names, numbers and units, signs that may count as units included."""
    return F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\x20\x09-\x0D‹›%€$£°]+", "")), _SPACE)


def windows(texts: DataFrame, window: int = WINDOW, shorter: Sequence[int] = ()) -> DataFrame:
    """One row per window of ``texts`` (key columns and ``text``): the keys, ``hash, at, n_words, slots``.

    There are windows of ``window`` words (one of all words in a text with fewer)
    and of each number of words in ``shorter``.

    ``slots`` holds, for a window with placeholders, the plain words in their
    places (empty for the others), joined; null where there are none.
    """
    keys = [c for c in texts.columns if c != "text"]
    made = texts.select(*keys, _template(F.col("text")).alias("all"), F.col("text").alias("text"))
    # Words that are left of nothing go from both lists together.
    both = F.zip_with("all", _plain(F.col("text")), lambda t, p: F.when(t != "", p))
    made = made.select(
        *keys,
        F.filter("all", lambda w: w != "").alias("t"),
        F.when(F.exists("all", lambda w: w.contains("›")), F.filter(both, lambda w: w.isNotNull())).alias("p"),
    ).filter(F.size("t") > 0)
    # Which words hold a placeholder, seen once for all windows.
    made = made.withColumn("marked", F.when(F.col("p").isNotNull(), F.transform("t", lambda w: w.contains("›"))))
    # In a text shorter than a window the places behind its end are null and do not change the hash.
    each = [_windows_of(window, f"greatest(size(t) - {window}, 0)")]
    each += [_windows_of(n, f"size(t) - {n}") for n in shorter]
    found = F.filter(F.concat(*each), lambda x: x["plain"])
    return made.select(*keys, F.explode(found).alias("x")).select(*keys, "x.hash", "x.at", "x.n_words", "x.slots")


def _windows_of(n: int, last: str) -> Column:
    """The windows of ``n`` words from the first word to the one numbered ``last``; none if that is negative."""
    hashed = ", ".join(f"get(t, i + {k})" for k in range(n))
    own = f"slice(t, i + 1, {n})"
    marked = " OR ".join(f"get(marked, i + {k})" for k in range(n))
    return F.expr(
        f"""transform(CASE WHEN {last} >= 0 THEN sequence(0, {last}) ELSE CAST(array() AS array<int>) END, i -> named_struct(
              'hash', xxhash64(least(size(t), {n}), {hashed}),
              'at', i,
              'n_words', least(size(t), {n}),
              'slots', CASE WHEN {marked}
                THEN array_join(transform({own}, (w, k) ->
                  CASE WHEN contains(w, '›') THEN coalesce(get(p, i + k), '') ELSE '' END), ' ') END,
              'plain', CASE WHEN {marked} THEN exists({own}, w -> NOT startswith(w, '‹') OR NOT endswith(w, '›'))
                ELSE true END))"""
    )


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, short_inside: bool = False) -> DataFrame:
    """``doc_id, text_hash, item_id, coverage, changed``: what each document holds of each item.

    ``changed`` says whether a slot has another value than in the item.
    """
    mine = items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    of_items = windows(mine, window).withColumnsRenamed({"at": "item_at", "slots": "item_slots"})
    size = of_items.groupBy("item_id").agg(F.count("*").alias("n"), F.max("item_at").alias("last"))
    n_windows, lengths = of_items.agg(F.count("*"), F.array_sort(F.collect_set("n_words"))).first()
    # At most window - 1 numbers.
    shorter = [n for n in lengths if n < window] if short_inside else []
    of_items = of_items.drop("n_words")
    if n_windows <= BROADCAST_WINDOWS:
        of_items, size = F.broadcast(of_items), F.broadcast(size)
    texts = docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")
    )
    met = windows(texts, window, shorter).join(of_items, "hash")
    # Per diagonal: the item's windows found, and the pairs of slot values seen in them.
    diagonal = met.groupBy("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("found"),
        F.collect_set(F.when(F.col("slots").isNotNull(), F.struct("item_slots", "slots"))).alias("slots"),
    )
    pairs = F.expr(
        """array_distinct(filter(flatten(transform(slots, s -> zip_with(
             split(s.item_slots, ' '), split(s.slots, ' '), (a, b) -> named_struct('a', a, 'b', b)))),
             x -> x.a != '' OR x.b != ''))"""
    )
    agreeing = diagonal.withColumn("pairs", pairs).filter(
        F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    )
    return (
        agreeing.groupBy("doc_id", "text_hash", "item_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"),
            F.max(F.exists("pairs", lambda x: x["a"] != x["b"])).alias("changed"),
        )
        .join(size, "item_id")
        .select("doc_id", "text_hash", "item_id", (F.col("found") / F.col("n")).alias("coverage"), "changed")
    )


def held_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    least_coverage: float = LEAST_COVERAGE,
    short_inside: bool = False,
) -> DataFrame:
    """``doc_id, text_hash, items, n_changed`` of each document that holds an item."""
    held = matches(docs, items, window, short_inside).filter(F.col("coverage") >= least_coverage)
    # At most one entry per benchmark item.
    return held.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.count(F.when(F.col("changed"), 1)).alias("n_changed"),
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    least_coverage: float = LEAST_COVERAGE,
    short_inside: bool = False,
) -> DataFrame:
    """``doc_id, contaminated, items, n_changed`` for each row of ``docs``."""
    held = held_items(docs, items, window, least_coverage, short_inside)
    slim = docs.select("doc_id", F.xxhash64("text").alias("_own"))
    same = slim["doc_id"].eqNullSafe(held["doc_id"]) & (slim["_own"] == held["text_hash"])
    kind = items.schema["item_id"].dataType.simpleString()
    return slim.join(held, same, "left").select(
        slim["doc_id"],
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"),
        F.coalesce("n_changed", F.lit(0).cast("bigint")).alias("n_changed"),
    )


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    least_coverage: float = LEAST_COVERAGE,
    short_inside: bool = False,
) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    held = held_items(docs, items, window, least_coverage, short_inside)
    same = docs["doc_id"].eqNullSafe(held["doc_id"]) & (F.xxhash64(docs["text"]) == held["text_hash"])
    return docs.join(held, same, "left_anti")
