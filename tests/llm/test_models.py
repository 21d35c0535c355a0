"""Toxic spans and language-model scores: exactness of the numerics, accuracy, odd rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sluicebox.llm import gru, toxicity


def test_marginals_against_step_by_step():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 200, 1, 64, 65, 130])
    scores, turns = rng.normal(0, 3, lengths.sum()), np.array([0.1, 0.7, 1.5])
    got, at = toxicity.marginals(scores, lengths, turns), 0
    step = np.array([[1, turns[0]], [turns[1], turns[2]]])
    for n in lengths:
        x = np.exp(scores[at : at + n])
        ahead, a = [], np.array([1.0, 0.0])
        for t in range(n):
            a = (a @ step) * np.array([1, x[t]])
            a /= a.sum()
            ahead.append(a)
        b = np.ones(2)
        for t in range(n - 1, -1, -1):
            both = ahead[t] * b
            assert np.isclose(both[1] / both.sum(), got[at + t])
            b = step @ (np.array([1, x[t]]) * b)
            b /= b.sum()
        at += n


def labelled(spark, n=240):
    rng = random.Random(1)
    plain = ["house", "river", "green", "walk", "table", "music", "stone", "paper"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 30))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), "vile" + rng.choice(["on", "er", "ish", "um", "ax", "ot"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int"),
    )


def test_held_out_documents_and_offsets(spark, odd):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id is not null and toxic is not null").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in toxicity.score_documents(docs, model).collect():
        if zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2:
            assert (row["score"] >= 0.5) == bool(truth[row["doc_id"]])
        found = " ".join(texts[row["doc_id"]][s["start"] : s["end"]] for s in row["spans"])
        assert all(w.startswith("vile") for w in found.split())
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] < 0.5 for r in rows)


def test_copies_of_a_labelled_row_change_nothing(spark):
    docs, labels = labelled(spark)
    once = toxicity.train(docs, labels, sample=60)
    copies = docs.filter("doc_id = 1").crossJoin(spark.range(300)).select("doc_id", "text")
    again = toxicity.train(docs.unionByName(copies), labels, sample=60)
    assert np.array_equal(once.weights, again.weights) and np.array_equal(once.scale, again.scale)


def test_without_labels_nothing_is_toxic(spark, odd):
    _, labels = labelled(spark, 3)
    model = toxicity.train(odd, labels.filter("false"))
    assert all(r["score"] < 0.01 for r in toxicity.score_documents(odd, model).collect())
    assert toxicity.score_documents(odd.filter("false"), model).count() == 0


def test_gradients_against_differences():
    network = gru.Network.new(np.array([5, 9, 7, 3, 2]), np.array([4, 1]), classes=2, hidden=3)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    texts = [np.array([1, 2, 6, 0]), np.array([3, 4, 5, 2, 1, 0])]
    ((x, y, fresh, _),) = gru.windows(texts, network.n_outputs)
    real = y >= 0

    def loss():
        states, _, _ = network.forward(x, np.zeros((2, 3)), fresh)
        return -network.log_probabilities(states.astype(np.float64)[real], y[real])[0].sum()

    states, _, kept = network.forward(x, np.zeros((2, 3)), fresh, keep=True)
    gradients = {k: np.zeros_like(v) for k, v in network.w.items()}
    _, back = network.log_probabilities(states[real], y[real], gradients)
    d_states = np.zeros(states.shape)
    d_states[real] = back
    network.backward(x, fresh, kept, d_states, gradients)
    rng = np.random.default_rng(0)
    for name, w in network.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            w[at] += 1e-3
            more = loss()
            w[at] -= 2e-3
            less = loss()
            w[at] += 1e-3
            assert abs((more - less) / 2e-3 - gradients[name][at]) < 2e-3


def test_probabilities_sum_to_one_and_lanes_do_not_matter():
    rng = np.random.default_rng(2)
    network = gru.Network.new(np.array([5, 9, 7, 3, 2]), np.array([4, 1]), classes=3, hidden=4)
    state = rng.normal(size=(1, 4)).astype(np.float32)
    logs = [network.log_probabilities(state, np.array([k]))[0][0] for k in range(network.n_outputs)]
    assert math.isclose(sum(map(math.exp, logs)), 1, rel_tol=1e-5)
    texts = [rng.integers(0, 7, n) for n in (1, 40, 33, 200, 7)]
    together = gru.score_texts(texts, network)
    alone = np.array([gru.score_texts([t], network)[0] for t in texts])
    assert np.allclose(together, alone, rtol=1e-4)


def test_scores_against_brute_force_counts(spark, monkeypatch):
    rng = random.Random(4)
    # So few known words that most go through the join.
    monkeypatch.setattr(gru, "KNOWN_WORDS", 6)
    rows = [(i, " ".join(rng.choice("Ab cd ef gh ij kl mn op qr".split()) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(500, None), (501, ""), (3, "unseen Words here"), (None, "ab ab")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, c int")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter(w for d, t in rows if not held(d) for w in gru.tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    got = sorted(gru.score_documents(df).collect(), key=lambda r: (str(r["doc_id"]), r["base_score"]))
    want = []
    for d, t in rows:
        words = gru.tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        want.append((d, held(d), len(words), sum(counts[w] > 0 for w in words), total, base))
    want.sort(key=lambda r: (str(r[0]), r[5]))
    for mine, theirs in zip(got, want, strict=True):
        assert tuple(mine)[:5] == theirs[:5]
        assert math.isclose(mine["base_score"], theirs[5], rel_tol=1e-9)
        assert mine["score"] < 0


def test_the_model_learns_from_every_training_document(spark, monkeypatch):
    # A habit that stands only in the late part of long texts and in many more texts than any sample holds.
    monkeypatch.setattr(gru, "PIECE", 64)
    seen = []
    real = gru.train
    monkeypatch.setattr(gru, "train", lambda coded, counts: seen.append((coded.agg({"n_tokens": "sum"}).first()[0], counts)) or real(coded, counts))
    rows = [(i, "ab cd " * 3) for i in range(3500)] + [(9000 + i, "ab cd " * 60 + "ef gh " * 3000) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    scores = {r["doc_id"]: r["score"] / r["n_tokens"] for r in gru.score_documents(df).collect()}
    ((tokens, counts),) = seen
    assert tokens == counts.total == sum(len(gru.tokens(t)) for d, t in rows if zlib.crc32(str(d).encode()) % 10)
    assert all(scores[9000 + i] > -0.1 for i in range(12))


def test_pieces_hold_every_token_once_behind_what_stands_before():
    texts = [np.arange(5 * gru.PIECE + 3), np.array([7])]
    parts, before = gru.pieces(texts, 99)
    assert np.array_equal(np.concatenate(parts), np.concatenate(texts))
    assert before.tolist() == [99, *[k * gru.PIECE - 1 for k in range(1, 6)], 99]
    got = [(int(a), int(b)) for x, y, _, _ in gru.windows(parts, before, lanes=2) for a, b in zip(x[y >= 0], y[y >= 0], strict=True)]
    want = [(b - 1 if b else 99, b) for b in range(5 * gru.PIECE + 3)] + [(99, 7)]
    assert sorted(got) == sorted(want)


def test_language_model_of_odd_rows(odd, none):
    assert gru.score_documents(odd).count() == odd.count()
    assert gru.score_documents(none).count() == 0


def test_words_are_looked_up_together(monkeypatch):
    texts = [" ", "", None, "A b\x1cc\xa0d\x85e", "ÄÖ ñandú. élan, x!!! ... 123 toolongaword", "b\tb\nb\x0bB\x0cb\rb " * 40]
    found = list(gru.byte_tokens(pa.array(texts)))
    assert [[w.decode() for w in words] for words in found] == [gru.tokens(t) for t in texts]
    words = list(dict.fromkeys(w for t in found for w in t))
    assert [gru.byte_shape(w) for w in words] == [gru.shape(w.decode()) for w in words]
    assert gru.word_hashes(words).tolist() == [gru.word_hash(w.decode()) for w in words]
    hashes = np.sort(gru.word_hashes(words[::2]))
    rank = np.where(np.arange(len(hashes)) < 3, np.arange(len(hashes)) + 1, -1)
    counts = gru.Counts(90, 30, hashes, np.arange(len(hashes)) + 2, rank, np.full(24, 9), np.full(24, 3), np.array([6, 5, 4, 3]))
    alone, small, calls = gru.Coder(counts), gru.Coder(counts, 5), []
    own = gru.Coder.look
    monkeypatch.setattr(gru.Coder, "look", lambda self, new: calls.append(len(new)) or own(self, new))
    every = [w for t in found for w in t]
    together = gru.Coder(counts).coded(every)
    # All new words of a group of texts in one call, each once.
    assert calls == [len(words)]
    for coder in (alone, small):
        one = [coder.coded([w]) for w in every]
        for k in range(4):
            assert together[k].tolist() == [o[k][0] for o in one]
    assert (together[1] != 0).any() and (together[0] < 4).any() and together[0][0] == 0
    edges = np.concatenate(([0], np.cumsum([len(t) for t in found])))
    rare, cut, n = gru._rare(together[1], together[0] - 4, edges)
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        want = Counter((int(h), int(o) - 4) for h, o in zip(together[1][a:b], together[0][a:b], strict=True) if h)
        assert {(r["h"], r["shape"]): r["n"] for r in rare.to_pylist()[cut[i] : cut[i + 1]]} == want
        assert n[i] == sum(want.values())
