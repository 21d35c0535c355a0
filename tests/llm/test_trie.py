"""The prefix trie: whole results against a plain walk over all sequences."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sluicebox.llm import files, prefixtrie
from sluicebox.session import scratch_dir

SCHEMA = "conv_id bigint, turn bigint, role string, text string, k1 string, depth int"


def slow(rows):
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, children, totals = defaultdict(list), defaultdict(list), {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in children[n]) or 1
        saved = sum(totals[k][1] for k in children[n]) + ((len(members[n]) - 1) * len(n[-1][1]) if n else 0)
        totals[n] = leaves, saved
    out = []
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(n))))
        up = min(members[n[:-1]]) if n else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(n), up, len(m), len(children[n]), *totals[n], sha))
    return sorted(out, key=repr)


def fast(df, **options):
    return sorted((tuple(r) for r in prefixtrie.trie_nodes(df, **options).collect()), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(130), *range(300, 340), 557, 901]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t if t else None, rng.choice(["u", "a", None]), rng.choice(["x", "", None, "é🙂" * 3])))
    # Conversations with very many turns, a copy of one, one without an opening one, rows without an id.
    for c in (7, 8, 250):
        rows += [(c, 100 + i, "u", str(i % 3)) for i in range(700)]
    return [*rows, (None, 1, "u", "x"), (7, 2000, None, None), (9, 2000, "u", "w " * 50_000)]


@pytest.mark.parametrize("options", [{}, {"least_heavy": 1, "queue_entries": 4}, {"least_heavy": 12, "queue_entries": 3}])
def test_nodes_are_those_of_a_plain_walk(spark, odd_rows, options):
    assert fast(frame(spark, odd_rows), **options) == slow(odd_rows)


def test_a_copied_conversation_and_equal_rows(spark):
    turns = [(None, "u", "a"), (1, "a", "b"), (1, "a", "b"), (2, "u", "c")]
    rows = [(c, *t) for c in range(1000, 1400) for t in turns]
    assert fast(frame(spark, rows), least_heavy=50) == slow(rows)


def test_no_conversation_has_no_node(spark):
    assert fast(frame(spark, [(None, 1, "u", "x")])) == []
    assert fast(frame(spark, [(None, 1, "u", "x")]).filter("false")) == []


def test_only_opening_turns_makes_a_bare_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "u", "a")]
    assert fast(frame(spark, rows)) == slow(rows) and len(slow(rows)) == 1


def test_queue_gives_all_messages_in_order_and_leaves_no_file(spark):
    folder = scratch_dir(spark, "queue")
    files.make_folder(folder)
    rng = random.Random(1)
    queue, want = prefixtrie.SpillingQueue(folder, 7), []
    for _ in range(200):
        message = (rng.randint(-5, 0), rng.randint(0, 9), rng.randint(0, 9), 1, 2)
        queue.push(message)
        want.append(message)
    assert queue.paths
    assert [queue.pop() for _ in want] == sorted(want) and queue.least() is None
    queue.close()
    system, path = files.place(folder)
    from pyarrow import fs

    assert system.get_file_info(fs.FileSelector(path)) == []
