"""Token counts against the library, vector codes against a plain Lloyd iteration."""

from __future__ import annotations

import hashlib
import json
import math
import random
import sys
from unicodedata import category

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluicebox.llm import tokencount, vectorcode

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", "  ", "\n", "\t", "a", "the", ".", ",", "!", "é", "́", "▁", "🙂", "<|endoftext|>", "'s", "'S", "1"]
ALPHABET += ["\x1c", "\xa0", "\x85", "aaaaaaa", "日本語", "　", "՘", "\U0001e030", "ſ", "\r\n", "한국", "ab", "ing", " th"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def by_library(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


# -- token counts


def test_counts_are_those_of_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0xD800)])) for _ in range(20)) for _ in range(500)]
    assert tokencount.counter(BYTES).counts(texts).tolist() == [by_library(library, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=3))
def test_any_texts(texts):
    library = Tokenizer.from_file(BYTES)
    assert tokencount.counter(BYTES).counts(texts).tolist() == [by_library(library, t) for t in texts]


def test_every_assigned_character_has_the_class_of_the_library(library):
    known = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and category(chr(c)) != "Cn"]
    cut = tokencount.counter(BYTES).words.findall
    for at in range(0, len(known), 1000):
        text = "\n".join(f"x{c}1{c}!{c} {c}" for c in known[at : at + 1000])
        assert [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)] == cut(text)


def test_long_texts_are_cut_in_runs(library, monkeypatch):
    monkeypatch.setattr(tokencount, "RUN", 50)
    monkeypatch.setattr(tokencount, "LONG", 200)
    rng = random.Random(2)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(700)) for _ in range(20)] + ["ab " * 500, "a" * 3000, "plain " * 300]
    assert tokencount.TokenCounter(BYTES).counts(texts).tolist() == [by_library(library, t) for t in texts]


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_ENTRIES", 3)
    texts = ["one two three four five six", "two three one", "six seven <|endoftext|> one"] * 2
    assert tokencount.TokenCounter(BYTES).counts(texts).tolist() == [by_library(library, t) for t in texts]


def one_at_a_time(word, vocabulary, merges):
    ranks = {pair: i for i, pair in enumerate(merges)}
    parts = list(word)
    while found := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]:
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts)


@pytest.mark.parametrize("merges", [[("a", "b"), ("ab", "a"), ("a", "a")], [("ab", "a"), ("aa", "b"), ("a", "b"), ("a", "a")]])
def test_merging_by_rank_is_merging_one_at_a_time(merges):
    letters = tokencount.byte_letters()
    vocabulary = {c: i for i, c in enumerate([*letters, *dict.fromkeys(a + b for a, b in merges)])}
    pairs = tokencount.PairTable(vocabulary, merges)
    assert pairs.monotone == (merges[0] == ("a", "b"))
    rng = random.Random(8)
    words = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    symbols = pairs.bytes[np.frombuffer("".join(words).encode(), np.uint8)]
    got = tokencount.surviving_symbols(symbols, np.array([len(w) for w in words]), pairs)
    assert got.tolist() == [one_at_a_time(w, vocabulary, merges) for w in words]


def test_other_files_are_refused(tmp_path):
    with open(BYTES, encoding="utf-8") as file:
        spec = json.load(file)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"truncation": {"x": 1}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError):
            tokencount.TokenCounter(str(path))


def test_counting_odd_rows(spark, odd, none, library):
    got = tokencount.count_tokens(odd, BYTES).collect()
    for row, source in zip(got, odd.collect(), strict=True):
        text = source["text"] or ""
        n = by_library(library, text)
        assert tuple(row) == (source["doc_id"], len(text.encode()), n, n > 512)
    assert tokencount.count_tokens(none, BYTES).count() == 0


# -- vector codes


def slow_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    values = np.array([v for _, v, _ in kept], np.int64)
    cut = np.array_split(np.arange(values.shape[1]), parts)
    books = [values[:entries, c].copy() for c in cut]

    def given_entries():
        out = [((values[:, None, c] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books, strict=True)]
        return [d.argmin(axis=1) for d in out], sum(d.min(axis=1) for d in out)

    for _ in range(rounds):
        codes, _ = given_entries()
        for c, b, own in zip(cut, books, codes, strict=True):
            for e in range(len(b)):
                if (own == e).any():
                    b[e] = values[own == e][:, c].sum(axis=0) // (own == e).sum()
    codes, error = given_entries()
    numbers = [str(v) for b in books for v in b.reshape(-1).tolist()]
    sha = hashlib.sha256(",".join(numbers).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(
        [
            (i, "".join(f"{c[k]:02x}" for c in codes), int(error[k]), by_label[label], sha)
            for k, (i, _, label) in enumerate(kept)
        ],
        key=repr,
    )


VECTORS = "vec_id bigint, embedding array<float>, label int, error string, width int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)


def single(values):
    return [float(np.float32(v)) for v in values]


@pytest.mark.parametrize(("dims", "grid"), [(16, 4), (32, 1000), (37, 7)])
def test_codes_are_those_of_a_plain_iteration(spark, dims, grid):
    rng = random.Random(dims)
    # A coarse grid makes many ties and entries that nobody uses.
    rows = [(i, single(rng.randrange(-grid, grid) / grid for _ in range(dims)), rng.choice([1, 2, None])) for i in range(150)]
    rows += [(3, rows[7][1], 5), (3, rows[7][1], 5), (None, rows[9][1], None), (500, [1e4] * dims, 1)]
    bad = [(600, None, 1), (601, [float("nan")] * dims, 1), (602, [float("inf")] * dims, 2), (603, [None] * dims, 2)]
    got = sorted((tuple(r) for r in vectorcode.code_report(vectors(spark, rows + bad)).collect()), key=repr)
    assert got == slow_codes(rows)


def test_few_rows_other_lengths_and_no_rows(spark):
    rows = [(i, single([i, 0.5] * 8), i % 2) for i in range(5)]
    got = vectorcode.code_report(vectors(spark, [*rows, (9, [1.0], 1), (10, [], None)])).collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow_codes(rows)
    assert vectorcode.code_report(vectors(spark, rows).filter("false")).count() == 0


def test_many_labels_are_salted(spark, monkeypatch):
    monkeypatch.setattr(vectorcode, "BROADCAST_LABELS", 1)
    rows = [(i, single([i % 7, -i % 5] * 8), [None, 1, 1, 2][i % 4]) for i in range(100)]
    got = vectorcode.code_report(vectors(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow_codes(rows)


def test_components_beyond_an_exact_error_are_refused(spark):
    with pytest.raises(Exception, match="do not fit"):
        vectorcode.code_report(vectors(spark, [(1, [3e38] * 16, 1)])).collect()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 5))
def test_active_entries_give_what_a_whole_look_gives(seed, grid):
    rng = np.random.default_rng(seed)
    values = rng.integers(-grid, grid + 1, (40, 3))
    old = rng.integers(-grid, grid + 1, (6, 3))
    moved = rng.random(6) < 0.5
    new = np.where(moved[:, None], rng.integers(-grid, grid + 1, (6, 3)), old)
    code, error = vectorcode.assign(values, old)
    got = vectorcode.reassign(values, new, (new != old).any(axis=1), code, error)
    want = vectorcode.assign(values, new)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


@pytest.mark.parametrize("size", [10, 10**4, 10**8])
def test_distances_are_exact_at_every_size(size):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-size, size, (20, 5)), rng.integers(-size, size, (4, 5))
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert vectorcode.distances(a, b).tolist() == want
