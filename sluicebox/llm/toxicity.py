"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic. A word's score for toxic is a sum of learned weights
of its hashed features (the word, its beginnings of 3 to 5 letters, its last 3,
and the words beside it); transitions have weights of their own. Labelled tokens
come from the labelled documents: a word, or a beginning of 4 or 5 letters, that
stands in toxic documents in many more contexts than in others makes its tokens toxic.
Forward-backward marginals give each word's probability; a logistic fit of two
sums over them gives the document's score, and runs of probable words its spans.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE`` of each
label, smallest hash of the id first, texts of up to ``SAMPLE_CHARS``); every
document is scored over its whole text. Forward and backward products of 2x2
matrices run over pieces of all texts of a batch at once and are then chained, so
a long text costs no more per word than a short one and gives exact marginals.

Null and empty texts have no words and get the score of such a document. Rows
with a null label teach nothing; several labels of one id count as toxic if any
is. A null id is never held out or learned from. Without labels of both kinds all
scores are 0. Repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import WORD, BoundedCache, remainder_of_crc32

SAMPLE = 1000
SAMPLE_CHARS = 20_000
FEATURES = 1 << 16
PIECE = 64
EPOCHS = 15
STEP_SIZE = 0.5
SHRINK = 1e-5
#: Contexts of a word in toxic documents at least, and times as many per word as elsewhere, for its tokens to be toxic.
LEAST_CONTEXTS, TIMES = 5, 10.0
PREDICTED = 0.3
CACHE_ENTRIES = 400_000

_WORDS = re.compile(WORD)
_LETTERS = re.compile(r"[\W\d_]+")


def core(word: str) -> str:
    """The letters of a word, in small."""
    return _LETTERS.sub("", word).lower()


def features(word: str) -> tuple[list[int], int, int]:
    """Hashed features of a word itself, as left neighbour and as right neighbour."""
    letters = core(word)

    def slot(kind: str, text: str) -> int:
        return zlib.crc32(f"{kind}{text}".encode("utf-8", "replace")) % FEATURES

    own = [slot("w", letters), slot("s", letters[-3:])]
    own += [slot("p", letters[:n]) for n in (3, 4, 5) if len(letters) >= n]
    return own, slot("l", letters), slot("r", letters)


@dataclass
class Model:
    weights: np.ndarray
    #: exp of the weights of clean-toxic, toxic-clean and toxic-toxic against clean-clean.
    turns: np.ndarray
    #: Weights of the document's score: constant, strongest word, mass of words.
    scale: np.ndarray


def _pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: index of each cell of the pieces (-1: none), first piece of each text, count."""
    count = -(-lengths // PIECE)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    rows = int(count.sum())
    owner = np.repeat(np.arange(len(lengths)), count)
    offset = (np.arange(rows) - first[owner]) * PIECE
    cell = offset[:, None] + np.arange(PIECE)
    return np.where(cell < lengths[owner][:, None], begin[owner][:, None] + cell, -1), first, count


def _sweep(x: np.ndarray, real: np.ndarray, step, first: np.ndarray, count: np.ndarray, start) -> np.ndarray:
    """Vectors after each step of ``step`` along the pieces of each text, exactly as if run text by text.

    ``x`` and ``real`` have a row per piece. First every piece is run from both
    unit vectors at once; the products are chained over the pieces of a text;
    then each piece is run again from its true vector.
    """
    rows = len(x)
    # A step reads one place of every piece: lay those side by side.
    x, real = np.ascontiguousarray(x.T), np.ascontiguousarray(real.T)
    zero, one = np.zeros(rows), np.ones(rows)
    p, q, r, s = one.copy(), zero.copy(), zero.copy(), one.copy()  # images of (1, 0) and of (0, 1)
    for t in range(PIECE):
        on = real[t]
        a, b = step(p, q, x[t])
        c, d = step(r, s, x[t])
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        p, q = np.where(on, a / top, p), np.where(on, b / top, q)
        r, s = np.where(on, c / top, r), np.where(on, d / top, s)
    u, v = np.empty(rows), np.empty(rows)
    now0, now1 = np.full(len(first), start[0]), np.full(len(first), start[1])
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        at = first[live] + k
        u[at], v[at] = now0[live], now1[live]
        a = p[at] * u[at] + r[at] * v[at]
        b = q[at] * u[at] + s[at] * v[at]
        now0[live], now1[live] = a / (a + b), b / (a + b)
    out = np.empty((2, PIECE, rows))
    for t in range(PIECE):
        a, b = step(u, v, x[t])
        total = a + b
        u, v = np.where(real[t], a / total, u), np.where(real[t], b / total, v)
        out[0, t], out[1, t] = u, v
    return out.transpose(2, 1, 0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normed forward and backward vectors of every word of texts laid end to end."""
    factor = np.exp(np.clip(scores, -30, 30))
    to_toxic, to_clean, stay = turns
    cells, first, count = _pieces(lengths)
    real = cells >= 0
    x = np.where(real, factor[cells], 1.0)

    def ahead(a, b, x):
        return a + b * to_clean, x * (a * to_toxic + b * stay)

    forward = np.empty((len(scores), 2))
    forward[cells[real]] = _sweep(x, real, ahead, first, count, (1.0, 0.0))[real]

    # Backwards the texts are turned round; a step takes in the word behind, so the word's own vector is the one before.
    n = len(scores)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    mirror = (ends - lengths)[owner] + ends[owner] - 1 - np.arange(n)
    turned = np.where(real, factor[mirror][cells], 1.0)

    def back(a, b, x):
        return a + to_toxic * x * b, to_clean * a + stay * x * b

    after = np.empty((n, 2))
    after[cells[real]] = _sweep(turned, real, back, first, count, (0.5, 0.5))[real]
    backward = np.full((n, 2), 0.5)
    place = np.arange(n) - (ends - lengths)[owner]
    backward[place > 0] = after[np.flatnonzero(place > 0) - 1]
    return forward, backward[mirror]


def marginals(scores: np.ndarray, lengths: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """P(toxic) of every word."""
    forward, backward = forward_backward(scores, lengths, turns)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


class Scorer:
    """Word scores through a bounded cache; texts in batches."""

    def __init__(self, model: Model, entries: int = CACHE_ENTRIES):
        self.model = model
        self.cache: dict[str, tuple[float, float, float]] = BoundedCache(entries)

    def parts(self, word: str) -> tuple[float, float, float]:
        own, left, right = features(word)
        w = self.model.weights
        return float(w[own].sum()), float(w[left]), float(w[right])

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        cache = self.cache
        words = [w for text in texts for w in text]
        found = list(map(cache.get, words))
        if None in found:
            kept = dict(zip(words, found, strict=True))
            new = [w for w, f in kept.items() if f is None]
            cache.make_room(len(new))
            for w in new:
                kept[w] = cache[w] = self.parts(w)
            found = [kept[w] for w in words]
        lengths = np.array([len(t) for t in texts], np.int64)
        if not words:
            return np.zeros(0), lengths
        own, left, right = np.array(found).T
        return _with_neighbours(own, left, right, lengths), lengths


def _with_neighbours(own: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Own scores plus what the word before gives as left and the word behind as right neighbour."""
    out = own.copy()
    starts = np.zeros(len(own), bool)
    starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    out[1:] += np.where(starts[1:], 0.0, left[:-1])
    out[:-1] += np.where(starts[1:], 0.0, right[1:])
    return out


def _document_sums(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: 1, the strongest word's log odds, and log of 1 plus the mass of likely words."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    most = np.zeros(len(lengths))
    np.maximum.at(most, owner, p)
    mass = np.bincount(owner, weights=np.where(p >= 0.2, p, 0.0), minlength=len(lengths))
    odds = np.log(np.clip(most, 1e-4, 1 - 1e-4) / (1 - np.clip(most, 1e-4, 1 - 1e-4)))
    return np.column_stack((np.ones(len(lengths)), odds, np.log1p(mass)))


def token_labels(texts: list[list[str]], toxic: np.ndarray) -> list[np.ndarray]:
    """Toxic tokens of labelled documents, by words and beginnings that belong to toxic ones.

    What counts is in how many contexts (word before, word behind) a word or
    beginning stands, so copies of one document do not make its words toxic.
    """
    contexts: dict[bool, set] = {True: set(), False: set()}
    size = {True: 1, False: 1}
    cores = []
    for words, label in zip(texts, toxic, strict=True):
        own = [core(w) for w in words]
        cores.append(own)
        size[bool(label)] += len(own)
        contexts[bool(label)].update(zip(["", *own], own, [*own[1:], ""], strict=False))
    seen = {label: Counter(k for _, w, _ in c for k in _keys(w)) for label, c in contexts.items()}
    strong = {
        k
        for k, n in seen[True].items()
        if n >= LEAST_CONTEXTS and n / size[True] >= TIMES * (seen[False][k] + 0.5) / size[False]
    }
    return [
        np.array([not strong.isdisjoint(_keys(w)) for w in own], bool) if label else np.zeros(len(own), bool)
        for own, label in zip(cores, toxic, strict=True)
    ]


def _keys(word: str) -> list[str]:
    """A word and its beginnings of 4 and 5 letters."""
    return [word] * bool(word) + [word[:n] + "*" for n in (4, 5) if len(word) >= n]


def fit(texts: list[str], toxic: list[int], weight_of_clean: float = 1.0) -> Model:
    """The field's weights by gradient ascent on the labelled tokens' likelihood, then the score's scale."""
    model = Model(np.zeros(FEATURES), np.exp(np.array([-3.0, 0.0, 0.0])), np.zeros(3))
    label = np.array(toxic, float)
    if not len(label) or label.min() == label.max():
        return Model(model.weights, model.turns, np.array([-30.0, 0.0, 0.0]))
    split = [_WORDS.findall(t) for t in texts]
    truth = np.concatenate(token_labels(split, label)) if split else np.zeros(0, bool)
    lengths = np.array([len(s) for s in split], np.int64)
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for s in split for w in s], np.int64)
    table = [features(w) for w in ids]
    sizes = np.array([len(t[0]) for t in table])
    own_slots = np.array([k for t in table for k in t[0]])
    own_word = np.repeat(np.arange(len(table)), sizes)
    left = np.array([t[1] for t in table])
    right = np.array([t[2] for t in table])
    starts = np.zeros(len(flat), bool)
    starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    inner = ~starts[1:]
    weights, logs = np.zeros(FEATURES), np.array([-3.0, 0.0, 0.0])
    past, past_logs = np.full(FEATURES, 1e-8), np.full(3, 1e-8)
    n_true = max(1.0, truth.sum())
    y = truth.astype(float)
    pairs_seen = np.array(
        [np.sum(~truth[:-1] & truth[1:] & inner), np.sum(truth[:-1] & ~truth[1:] & inner), np.sum(truth[:-1] & truth[1:] & inner)]
    ) + np.array([np.sum(truth & starts), 0, 0])
    for _ in range(EPOCHS):
        own = np.bincount(own_word, weights=weights[own_slots], minlength=len(table))
        scores = _with_neighbours(own[flat], weights[left][flat], weights[right][flat], lengths)
        turns = np.exp(logs)
        forward, backward = forward_backward(scores, lengths, turns)
        both = forward * backward
        p = both[:, 1] / both.sum(axis=1)
        miss = y - p
        by_word = np.bincount(flat, weights=miss, minlength=len(table))
        gradient = np.bincount(own_slots, weights=by_word[own_word], minlength=FEATURES)
        as_left = np.bincount(flat[:-1], weights=np.where(inner, miss[1:], 0.0), minlength=len(table))
        as_right = np.bincount(flat[1:], weights=np.where(inner, miss[:-1], 0.0), minlength=len(table))
        gradient += np.bincount(left, weights=as_left, minlength=FEATURES)
        gradient += np.bincount(right, weights=as_right, minlength=FEATURES)
        gradient = gradient / n_true - SHRINK * weights
        # Expected turns between neighbours, from both vectors and the factors between.
        x = np.exp(np.clip(scores, -30, 30))[1:]
        f, b = forward[:-1], backward[1:]
        four = [f[:, 0] * b[:, 0], f[:, 0] * turns[0] * x * b[:, 1], f[:, 1] * turns[1] * b[:, 0], f[:, 1] * turns[2] * x * b[:, 1]]
        total = np.where(inner, sum(four), 1.0)
        expected = np.array([np.sum(np.where(inner, z / total, 0.0)) for z in four[1:]])
        expected[0] += p[starts].sum()
        slope = (pairs_seen - expected) / n_true
        past += gradient**2
        past_logs += slope**2
        weights += STEP_SIZE * gradient / np.sqrt(past)
        logs = np.clip(logs + STEP_SIZE * slope / np.sqrt(past_logs), -6, 6)
    model = Model(weights, np.exp(logs), np.zeros(3))
    own = np.bincount(own_word, weights=weights[own_slots], minlength=len(table))
    scores = _with_neighbours(own[flat], weights[left][flat], weights[right][flat], lengths)
    sums = _document_sums(marginals(scores, lengths, model.turns), lengths)
    importance = np.where(label > 0, 1.0, weight_of_clean)
    return Model(model.weights, model.turns, _logistic(sums, label, importance))


def _logistic(x: np.ndarray, y: np.ndarray, importance: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic fit with a little shrinkage, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (importance * (y - p)) - 0.1 * w
        h = (x * (importance * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, hold_out: int | None = 2) -> Model:
    """Fit on at most ``sample`` labelled documents of each kind; ids whose crc32 mod 4 is ``hold_out`` stay out."""
    known = labels.filter("doc_id is not null and toxic is not null")
    if hold_out is not None:
        known = known.filter(remainder_of_crc32("doc_id", 4) != hold_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    picked = known.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(
        known.filter("toxic = 0").orderBy(order, "doc_id").limit(sample)
    )
    # At most twice ``sample`` ids, and as many texts of bounded length, reach the driver.
    texts = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    # Rows that repeat an id and its text are one text, so copies neither crowd out others nor weigh more.
    distinct = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"])
    kinds = [distinct.filter(F.col("toxic") == kind).orderBy(order, "doc_id", "text").limit(sample) for kind in (0, 1)]
    rows = sorted(kinds[0].unionByName(kinds[1]).collect(), key=lambda r: (r["doc_id"], r["text"]))
    clean = sum(1 for r in rows if not r["toxic"])
    toxic = len(rows) - clean
    # The sample has as many toxic as clean rows where there are enough; the scale is fitted to the true shares.
    share = (counts.get(0, 0) / max(1, clean)) / (counts.get(1, 0) / max(1, toxic)) if toxic and clean else 1.0
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], share)


def spans_of(text: str, p: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """``start, end, p`` of runs of words of probability ``least`` or more; code points, ends exclusive."""
    out: list[tuple[int, int, float]] = []
    last = -2
    for k, found in enumerate(_WORDS.finditer(text)):
        if p[k] >= least:
            if last == k - 1:
                start, _, most = out.pop()
                out.append((start, found.end(), max(most, float(p[k]))))
            else:
                out.append((found.start(), found.end(), float(p[k])))
            last = k
    return out


def score_documents(docs: DataFrame, model: Model, least: float = 0.5, with_spans: bool = True) -> DataFrame:
    """``doc_id, score[, spans]``: probability of toxic and the offending spans of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double"
    if with_spans:
        schema += ", spans array<struct<start:int,end:int,p:double>>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                scores, lengths = scorer.scores([_WORDS.findall(t) for t in texts])
                p = marginals(scores, lengths, model.turns) if len(scores) else scores
                z = _document_sums(p, lengths) @ model.scale
                columns = [some.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]
                names = ["doc_id", "score"]
                if with_spans:
                    ends = np.cumsum(lengths)
                    found = [
                        [dict(zip(("start", "end", "p"), s, strict=True)) for s in spans_of(t, p[e - n : e], least)]
                        if n and p[e - n : e].max() >= least
                        else []
                        for t, n, e in zip(texts, lengths, ends, strict=True)
                    ]
                    columns.append(pa.array(found, span_type))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
