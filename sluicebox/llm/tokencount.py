"""Token counts of whole texts for a byte-level BPE vocabulary, by merging arrays of symbols.

A text is cut at the vocabulary's special strings (one token each) and what is
left into pre-tokens. Pre-tokens that were not met before are held together as
one ragged numpy array of symbols. In a round every pre-token applies its own
lowest-ranked pair wherever it stands, all pre-tokens at once, until no pair is
left that the vocabulary knows; the symbols that survive are its tokens. Ids are
never put out, only counted.

Applying a pair in all places at once gives what one merge at a time gives if
nothing that a merge makes can be part of a pair of lower rank. That is checked
when a vocabulary is loaded; where it does not hold, only the leftmost place of
a pair is merged in a round. A file with other steps than these (a normalizer,
another pre-tokenizer, dropout and the like) is refused.

Null and empty texts have no bytes and no tokens. Every row stays, repeated ids
too; a null id stays null. Other columns are not read. A very long text is worked
through in runs of ``RUN`` pre-tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import BoundedCache

LIMIT = 512
#: Units that are looked up at once, and characters from which a text is cut in runs of them.
RUN, LONG = 1 << 16, 1 << 20
#: Counts kept per Python worker. Longer units are not kept, so the cache stays below some 50 MB.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 40
#: Symbols that are merged at once.
SYMBOLS = 1 << 20

# The pre-token pattern of byte-level BPE, and the code points that stand for bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter a vocabulary writes for each byte: itself if printed, else one from 256 on."""
    shown = set(PRINTED)
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class PairTable:
    """Rank and product of each pair of symbols, found by a binary search over arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.width = max(vocabulary.values(), default=0) + 1
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        keys, ranks = left * self.width + right, np.arange(len(merges), dtype=np.int32)
        # Of a pair that is listed twice the later rank holds, as in a map that is filled in order.
        order = np.lexsort((-ranks, keys))
        first = np.append(True, np.diff(keys[order]) != 0)[: len(order)]
        self.keys, self.ranks, self.made = keys[order][first], ranks[order][first], made[order][first]
        self.monotone = self._is_monotone()
        self.bytes = np.array([vocabulary[c] for c in byte_letters()], np.int32)

    def _is_monotone(self) -> bool:
        """Whether no pair with a merge's product as a part ranks below that merge."""
        lowest = np.full(self.width, _NONE)
        for part in (self.keys // self.width, self.keys % self.width):
            np.minimum.at(lowest, part, self.ranks)
        return bool(np.all(lowest[self.made] > self.ranks))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``_NONE`` for no pair) and products."""
        if not len(self.keys):
            return np.full(len(left), _NONE), np.zeros(len(left), np.int32)
        wanted = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE), self.made[at]


def surviving_symbols(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Symbols left of each sequence; ``symbols`` holds the sequences end to end, none is empty."""
    left = np.asarray(lengths, np.int64).copy()
    owners = np.repeat(np.arange(len(left)), left)
    last = np.cumsum(left) - 1
    rank = np.full(len(symbols), _NONE)
    made = np.zeros(len(symbols), np.int32)

    def rate(at: np.ndarray) -> None:
        """Rank and product of the pair that begins in each place of ``at``."""
        inner = at[(at + 1 < len(symbols))]
        inner = inner[owners[inner] == owners[inner + 1]]
        rank[at] = _NONE
        rank[inner], made[inner] = pairs.find(symbols[inner], symbols[inner + 1])

    symbols = symbols.astype(np.int32)
    rate(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        # A sequence without a pair is done: its symbols are its tokens.
        left[owners[starts]] = sizes
        going = np.repeat(least != _NONE, sizes)
        if not going.all():
            symbols, owners, rank, made = symbols[going], owners[going], rank[going], made[going]
            sizes, least = sizes[least != _NONE], least[least != _NONE]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == np.repeat(least, sizes))
        # Places that overlap (a pair of equal symbols in a run) count from the run's first one, every other.
        run = np.cumsum(np.append(True, np.diff(hit) != 1)) - 1
        begin = hit[np.append(True, np.diff(run) != 0)]
        hit = hit[(hit - begin[run]) % 2 == 0]
        if not pairs.monotone:
            hit = hit[np.append(True, np.diff(owners[hit]) != 0)]
        symbols[hit] = made[hit]
        stays = np.ones(len(symbols), bool)
        stays[hit + 1] = False
        moved = np.cumsum(stays) - 1
        symbols, owners, rank, made = symbols[stays], owners[stays], rank[stays], made[stays]
        new = moved[hit]
        changed = np.zeros(len(symbols), bool)
        changed[new] = True
        changed[new[new > 0] - 1] = True
        rate(np.flatnonzero(changed))
    return left


class TokenCounter:
    """Token counts of whole texts by one vocabulary file, with a bounded cache of pre-tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._refuse_others(spec)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairTable(model["vocab"], merges)
        self.words = regex.compile(PATTERN)
        self.spaced = re.compile(r" \s|\s ")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.path, self.library = path, None
        self.cache: dict[str, int] = BoundedCache(CACHE_ENTRIES)

    @staticmethod
    def _refuse_others(spec: dict) -> None:
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix"))
            and not any(model.get(k) for k in ("end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space")
            and cut.get("use_regex", True)
            and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not plain:
            raise ValueError("only plain byte-level BPE files are counted")

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; units that are new are merged together for many texts."""
        totals = np.zeros(len(texts), np.int64)
        owners: list[int] = []
        stretches: list[str] = []
        for i, text in enumerate(texts):
            at = 0
            for found in self.special.finditer(text) if self.special else ():
                totals[i] += 1
                owners.append(i)
                stretches.append(text[at : found.start()])
                at = found.end()
            owners.append(i)
            stretches.append(text[at:] if at else text)
        sums = np.zeros(len(stretches), np.int64)
        doubtful: set[int] = set()
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, stretch in enumerate(stretches):
            for units in self._units(stretch):
                held.append((k, units))
                size += len(units)
                if size >= RUN:
                    self._add(held, sums, doubtful)
                    held, size = [], 0
        self._add(held, sums, doubtful)
        for k in doubtful:
            sums[k] = self._by_library(stretches[k])
        np.add.at(totals, owners, sums)
        return totals

    def _units(self, text: str) -> Iterator[list[str]]:
        """The text in units that no pre-token reaches across; one that stands behind a space lacks
        that space, any other has a space put behind it.

        A single space between two that are none always ends a pre-token, so such
        texts are split there and a word with its marks is one unit. Others are cut
        by the pattern, and long ones in runs.
        """
        if not text:
            return
        if len(text) <= LONG and not self.spaced.search(text) and text[0] != " " and text[-1] != " ":
            units = text.split(" ")
            units[0] += " "
            yield units
            return
        found = (m.group() for m in self.words.finditer(text))
        while parts := list(islice(found, RUN)):
            yield [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else p + " " for p in parts]

    def _add(self, held: list[tuple[int, list[str]]], sums: np.ndarray, doubtful: set[int]) -> None:
        """Add up the held units; stretches with a character in doubt are left to the library."""
        get = self.cache.get
        counted = [(k, units, list(map(get, units))) for k, units in held]
        new: dict[str, None] = {}
        for _, units, found in counted:
            if None in found:
                new.update((u, None) for u, n in zip(units, found, strict=True) if n is None)
        # Characters that Unicode assigned lately have a class in one library and none in another.
        odd = {c for c in set("".join(new)) if c > "\x7f" and category(c) == "Cn"}
        if odd:
            new = {u: None for u in new if odd.isdisjoint(u)}
        known = self._learn_units(list(new))
        for k, units, found in counted:
            if None in found:
                found = [known.get(u) if n is None else n for u, n in zip(units, found, strict=True)]
            if None in found:
                doubtful.add(k)
            else:
                sums[k] += sum(found)

    def _learn_units(self, new: list[str]) -> dict[str, int]:
        cut = self.words.findall
        words = [cut(u[:-1]) if u[-1] == " " else cut(" " + u) for u in new]
        counts = self.merged(list(dict.fromkeys(w for ws in words for w in ws)))
        known = {u: sum([counts[w] for w in ws]) for u, ws in zip(new, words, strict=True)}
        short = [u for u in new if len(u) <= CACHE_CHARS]
        self.cache.make_room(len(short))
        self.cache.update((u, known[u]) for u in short)
        return known

    def _by_library(self, text: str) -> int:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        parts = [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        counts = self.merged(list(dict.fromkeys(parts)))
        return sum(counts[p] for p in parts)

    def merged(self, words: list[str]) -> dict[str, int]:
        """Tokens of each pre-token, merged together in arrays of about ``SYMBOLS`` symbols."""
        known: dict[str, int] = {}
        coded = [w.encode() for w in words]
        sizes = np.array([len(c) for c in coded], np.int64)
        group = (np.cumsum(sizes) - sizes) // SYMBOLS
        edges = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(words)]
        for a, b in zip(edges, edges[1:], strict=False):
            symbols = self.pairs.bytes[np.frombuffer(b"".join(coded[a:b]), np.uint8)]
            known.update(zip(words[a:b], surviving_symbols(symbols, sizes[a:b], self.pairs).tolist(), strict=True))
        return known


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The counter of a file; a worker keeps one at a time."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row: a map over Arrow batches, no shuffle."""

    def run(batches):
        counts = counter(tokenizer).counts
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = pc.fill_null(some.column(1), "")
                n = counts(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pc.cast(pc.binary_length(texts), pa.int64()),
                        pa.array(n),
                        pa.array(n > limit),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
