"""Language-model scores from a gated recurrent network in numpy.

Tokens are the words of a text (A-Z in small) and one end. Words are counted over
all training documents. The most frequent ``VOCABULARY`` words have outputs of
their own, dealt to classes of about equal mass; every other word belongs to the
class of its shape (marks, letters beyond a-z, length), inside which its count
decides. The model gives log10 P(class | what came before) + log10 P(word | class,
what came before); for shape classes the second factor is (c + 0.1) / (n + 0.1
(v + 1)) with the class's tokens n and distinct words v, so unseen words have a
probability too.

The network is trained by truncated backpropagation with its state carried from
window to window, on every token of every training document; all counts cover
them, too. Training goes in ``ROUNDS``: each takes a share of the documents, tasks
learn from their part of it side by side, all from the same weights, and a sum over
the tasks gives the mean weights that the next round starts from. A text is learned
in pieces of ``PIECE`` tokens, the first input of each the word before it, so that a
long one fills no lane alone; few documents are gone over several times. Every
document is scored as a whole, its state carried over all its windows; documents
run side by side in lanes.

The counts of the most frequent words travel with the tasks, at most
``KNOWN_WORDS``; all other words of a document are joined with the counts by a
shuffle. Words are known by 64-bit hash there.

Null, empty and blank texts are the end alone. A null id counts as empty text for
the hash that holds documents out. Repeated rows get equal scores, each in its
own row. An empty table, or one without training documents, gives scores with
counts of zero. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import WORD, remainder_of_crc32, written

VOCABULARY = 2000
CLASSES = 32
HIDDEN = 16
WINDOW = 32
LANES = 256
KNOWN_WORDS = 400_000
#: Shares of the training documents between two means; each task learns from at least so many tokens of one.
ROUNDS, TASK_TOKENS = 4, 500_000
#: Training goes on for so many tokens, over the same documents again, but not more often than this.
LEAST_TOKENS, MOST_PASSES = 4_000_000, 4
PIECE = 2048
#: Documents and tokens that are held at a time.
GROUP_ROWS, GROUP_TOKENS = 4096, 2_000_000
#: Documents whose words are looked up at a time.
CODED_ROWS = 256
#: Numbers of a row of a learner's state.
BLOCK = 4096
#: Columns of one softmax over the classes, so its numbers stay near the processor.
COLUMNS = 2048
RATE, CLIP, SEED = 0.01, 5.0, 7
HELD_OUT, MODULUS = 0, 10
CACHE_ENTRIES = 400_000
#: The end of a text, counted and scored as a word; no word holds a space.
END = " "
_END = END.encode()

_WORDS = re.compile(WORD)
SHAPES = 24
_LETTERS = tuple((k, frozenset(letters)) for k, letters in ((3, "äöüß"), (4, "ñíóáú"), (5, "éèêç")))


def tokens(text: str | None) -> list[str]:
    # Bytes in small touch A-Z only, and quicker than a translation table does.
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    words.append(END)
    return words


def byte_tokens(texts: pa.Array) -> Iterator[list[bytes]]:
    """The ``tokens`` of each text in UTF-8; bytes are split at the space and the controls 9 to 13, and nowhere else."""
    wide = pa.types.is_large_string(texts.type)
    for text in texts.cast(pa.large_binary() if wide else pa.binary()).to_pylist():
        words = text.lower().split() if text else []
        words.append(_END)
        yield words


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array(list(map(xxh64_intdigest, words)), np.uint64).view(np.int64)


def word_hash(word: str) -> int:
    return int(word_hashes([word.encode("utf-8", "replace")])[0])


def shape(word: str) -> int:
    """One of SHAPES classes: kind of letters, a mark at the end, short or long."""
    if word.isascii():
        body = word.rstrip(".,!?;:")
        kind = 0 if body.isalpha() else 1
    else:
        kind = 2
        for k, letters in _LETTERS:
            if not letters.isdisjoint(word):
                kind = k
                break
    return kind * 4 + 2 * (word[-1] in ".,!?;:") + (len(word) > 7)


def byte_shape(word: bytes) -> int:
    """The ``shape`` of a word in UTF-8."""
    if not word.isascii():
        return shape(word.decode("utf-8", "replace"))
    return 4 * (not word.rstrip(b".,!?;:").isalpha()) + 2 * (word[-1] in b".,!?;:") + (len(word) > 7)


def count_words(docs: DataFrame) -> DataFrame:
    """``h, shape, c, word`` over all rows of ``docs``; ``word`` is only an example of the hash."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            words = list(counts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(word_hashes(words)),
                    pa.array(list(map(byte_shape, words)), pa.int32()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["h", "shape", "c"],
            )

        for batch in batches:
            for words in byte_tokens(batch.column(0)):
                counts.update(words)
                if len(counts) >= 1_000_000:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    counted = docs.select("text").mapInArrow(run, "h bigint, shape int, c bigint")
    return counted.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


@dataclass
class Counts:
    """What every task knows: totals, frequent words by hash, and each shape's mass outside the vocabulary."""

    total: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    shape_tokens: np.ndarray
    shape_words: np.ndarray
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def base(self, c) -> float:
        return math.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def in_shape(self, c, kind: int) -> float:
        return math.log10((c + 0.1) / (self.shape_tokens[kind] + 0.1 * (self.shape_words[kind] + 1)))


def known_counts(counted: DataFrame, vocabulary: int = VOCABULARY, known_words: int = KNOWN_WORDS) -> Counts:
    """The totals, and the words that are frequent enough for at most ``known_words`` to be so."""
    total = counted.agg(F.sum("c"), F.count("*")).first()
    # Words per count: few distinct counts, and words with a count of n are at most total / n.
    ladder = counted.groupBy("c").agg(F.count("*").alias("n"))
    high = sorted(ladder.filter(F.col("c") * known_words > F.lit(total[0] or 0)).collect(), reverse=True)
    low = sorted(ladder.filter(F.col("c") * known_words <= F.lit(total[0] or 0)).filter("c >= 2").collect(), reverse=True)
    least, seen = 1 << 62, 0
    for row in [*high, *low]:
        if seen + row["n"] > known_words:
            break
        least, seen = row["c"], seen + row["n"]
    rows = counted.filter(F.col("c") >= least).select("h", "shape", "c").toPandas().sort_values("h")
    h, c, s = (rows[k].to_numpy(np.int64) for k in ("h", "c", "shape"))
    order = np.lexsort((h, -c))
    # The end has an output of its own however rare it is.
    end = word_hash(END)
    chosen = [i for i in order[: vocabulary + 1] if h[i] != end][: vocabulary - 1]
    at = np.searchsorted(h, end)
    rank = np.full(len(h), -1, np.int64)
    rank[chosen] = np.arange(1, len(chosen) + 1)
    if at < len(h) and h[at] == end:
        rank[at] = 0
    shape_tokens, shape_words = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for row in counted.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        shape_tokens[row["shape"]], shape_words[row["shape"]] = row["c"], row["n"]
    listed = rank >= 0
    np.subtract.at(shape_tokens, s[listed], c[listed])
    np.subtract.at(shape_words, s[listed], 1)
    own = np.ones(len(chosen) + 1, np.int64)
    own[rank[listed]] = c[listed]
    return Counts(int(total[0] or 0), int(total[1]), h, c, rank, shape_tokens, shape_words, own)


class Coder:
    """Words to places in arrays of output numbers, base scores, scores inside the shape and hashes.

    The arrays fill as words are met and start anew at ``limit`` words, which only
    costs time.
    """

    def __init__(self, counts: Counts, limit: int = CACHE_ENTRIES):
        self.counts = counts
        self.size = len(counts.vocabulary)
        self.limit = limit
        self.place: dict[bytes, int] = {}
        self.clear(1024)

    def clear(self, room: int) -> None:
        self.place.clear()
        self.outputs, self.hashes = np.zeros(room, np.int32), np.zeros(room, np.int64)
        self.base, self.inside = np.zeros(room), np.zeros(room)

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Output numbers, the hashes of words not known here (else 0), base scores and scores inside the shape."""
        k = self.counts
        h = word_hashes(words)
        at = np.searchsorted(k.hashes, h)
        known = np.zeros(len(words), bool)
        inner = at < len(k.hashes)
        known[inner] = k.hashes[at[inner]] == h[inner]
        c, rank = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        c[known], rank[known] = k.counts[at[known]], k.rank[at[known]]
        end = np.array([w == _END for w in words], bool)
        if k.total:
            c[end] = k.vocabulary[0]
        rank[end], known[end] = 0, True
        kinds = np.zeros(len(words), np.int64)
        others = np.flatnonzero((rank <= 0) & ~end)
        kinds[others] = [byte_shape(words[i]) for i in others.tolist()]
        outputs = rank.copy()
        outputs[others] = self.size + kinds[others]
        base = np.where(known, np.log10((c + 0.1) / (k.total + 0.1 * (k.distinct + 1))), 0.0)
        some = others[known[others]]
        inside = np.zeros(len(words))
        inside[some] = np.log10((c[some] + 0.1) / (k.shape_tokens[kinds[some]] + 0.1 * (k.shape_words[kinds[some]] + 1)))
        return outputs, np.where(known, 0, np.where(h == 0, 1, h)), base, inside

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Outputs, hashes, base scores and scores inside the shape of ``words``."""
        at = self._places(words)
        return self.outputs[at], self.hashes[at], self.base[at], self.inside[at]

    def _places(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = {words[i] for i in missing.tolist()}
            if len(self.place) + len(new) > self.limit:
                self.clear(len(self.outputs))
                new, missing = set(words), np.arange(len(words))
            need = len(self.place) + len(new)
            if need > len(self.outputs):
                room = max(need, 2 * len(self.outputs))
                for name in ("outputs", "hashes", "base", "inside"):
                    old = getattr(self, name)
                    grown = np.zeros(room, old.dtype)
                    grown[: len(old)] = old
                    setattr(self, name, grown)
            first, fresh = len(self.place), list(new)
            self.place.update(zip(fresh, range(first, need), strict=True))
            own = slice(first, need)
            self.outputs[own], self.hashes[own], self.base[own], self.inside[own] = self.look(fresh)
            found[missing] = [self.place[words[i]] for i in missing.tolist()]
        return found


def _log_softmax(logits: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln softmax of each column's chosen entry; also the exponentials and their sums. Overwrites ``logits``."""
    logits -= logits.max(axis=0)
    picked = logits[chosen, np.arange(len(chosen))]
    e = np.exp(logits, out=logits)
    total = e.sum(axis=0)
    return picked - np.log(total), e, total


@dataclass
class Network:
    """Input vectors, gates, and the two softmaxes; ``bounds`` cut the vocabulary into classes."""

    w: dict[str, np.ndarray]
    bounds: np.ndarray
    n_outputs: int

    @staticmethod
    def new(vocabulary: np.ndarray, shape_tokens: np.ndarray, classes: int = CLASSES, hidden: int = HIDDEN) -> Network:
        """Small random weights; the softmax biases are the logs of the counted shares."""
        rng = np.random.default_rng(SEED)
        v = len(vocabulary)
        mass = np.cumsum(vocabulary) / max(1, vocabulary.sum())
        cuts = np.searchsorted(mass, np.arange(1, classes) / classes, side="left") + 1
        bounds = np.unique(np.concatenate(([0], np.minimum(cuts, v), [v])))
        n_classes = len(bounds) - 1 + len(shape_tokens)
        per_class = np.add.reduceat(vocabulary, bounds[:-1]) if v else np.zeros(0)
        share = np.concatenate((per_class, shape_tokens)) + 1.0
        small = lambda *size: rng.normal(0, 0.1, size).astype(np.float32)
        w = {
            "inputs": small(v + len(shape_tokens) + 1, 3 * hidden),
            "gates": small(hidden, 2 * hidden),
            "fresh": small(hidden, hidden),
            "class": small(hidden, n_classes) * 0.1,
            "class_bias": np.log(share / share.sum()).astype(np.float32),
            "word": small(hidden, v) * 0.1,
            "word_bias": np.log(np.maximum(vocabulary, 1)).astype(np.float32),
        }
        return Network(w, bounds, v + len(shape_tokens))

    @property
    def hidden(self) -> int:
        return len(self.w["gates"])

    def classes_of(self, y: np.ndarray) -> np.ndarray:
        v = self.bounds[-1]
        n = len(self.bounds) - 1
        return np.where(y < v, np.searchsorted(self.bounds, y, side="right") - 1, n + y - v)

    def forward(self, x: np.ndarray, h: np.ndarray, fresh: np.ndarray, keep: bool = False):
        """States of a window: ``x`` (T, B) inputs, ``h`` (B, H) the state before, ``fresh`` where a text begins.

        Inside, a row is a feature and a column a lane, so every step runs over whole rows.
        """
        size = self.hidden
        # The logistic function by way of the hyperbolic tangent, which cannot overflow: of half the sum.
        table = np.ascontiguousarray(self.w["inputs"].T)
        table[: 2 * size] *= 0.5
        gates, renew = 0.5 * self.w["gates"].T, np.ascontiguousarray(self.w["fresh"].T)
        given = table.take(x.reshape(-1), axis=1).reshape(3 * size, *x.shape)
        states = np.empty((size, *x.shape), table.dtype)
        begins = fresh.any(axis=1)
        h = np.ascontiguousarray(h.T, table.dtype)
        kept = []
        for t in range(len(x)):
            if begins[t]:
                h = np.where(fresh[t], table.dtype.type(0), h)
            g = gates @ h
            g += given[: 2 * size, t]
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r = g[:size], g[size:]
            c = renew @ (r * h)
            c += given[2 * size :, t]
            np.tanh(c, out=c)
            after = c - h
            after *= z
            after += h
            if keep:
                kept.append((h, z, r, c))
            h = states[:, t] = after
        return states.transpose(1, 2, 0), h.T, kept

    def log_probabilities(self, states: np.ndarray, y: np.ndarray, gradients: dict | None = None):
        """ln P(y) of flat ``states`` and targets; with ``gradients`` also d(-sum)/d(states)."""
        order = np.arange(len(y))
        logs, back = self._by_class(states.T, y, order, gradients)
        return logs, None if back is None else back.T

    def _by_class(self, states: np.ndarray, y: np.ndarray, at: np.ndarray, gradients: dict | None = None):
        """``log_probabilities`` of the columns ``at`` of ``states``, in whose order the answers are; zero elsewhere."""
        classes = self.classes_of(np.arange(self.n_outputs)).astype(np.uint16)
        cls = classes[y[at]]
        by_class = np.argsort(cls, kind="stable")
        at, cls = at[by_class], cls[by_class]
        s, y = states.take(at, axis=1), y[at]
        back = np.empty_like(s) if gradients is not None else None
        logs = np.empty(len(at), s.dtype)
        edges = np.searchsorted(cls, np.arange(len(self.bounds)))
        for a in range(0, len(at), COLUMNS):
            b = min(a + COLUMNS, len(at))
            logits = self.w["class"].T @ s[:, a:b]
            logits += self.w["class_bias"][:, None]
            logs[a:b], e, total = _log_softmax(logits, cls[a:b])
            if gradients is not None:
                e /= total
                e[cls[a:b], np.arange(b - a)] -= 1
                gradients["class"] += s[:, a:b] @ e.T
                gradients["class_bias"] += e.sum(axis=1)
                back[:, a:b] = self.w["class"] @ e
        for k in range(len(self.bounds) - 1):
            low, high = self.bounds[k], self.bounds[k + 1]
            a, b = edges[k], edges[k + 1]
            if a == b or high - low < 2:
                continue
            own = y[a:b] - low
            logits = self.w["word"][:, low:high].T @ s[:, a:b]
            logits += self.w["word_bias"][low:high, None]
            inside, e, total = _log_softmax(logits, own)
            logs[a:b] += inside
            if gradients is not None:
                e /= total
                e[own, np.arange(b - a)] -= 1
                gradients["word"][:, low:high] += s[:, a:b] @ e.T
                gradients["word_bias"][low:high] += e.sum(axis=1)
                back[:, a:b] += self.w["word"][:, low:high] @ e
        out = np.zeros(states.shape[1], s.dtype)
        out[at] = logs
        if back is None:
            return out, None
        d_states = np.zeros(states.shape, s.dtype)
        d_states[:, at] = back
        return out, d_states

    def backward(self, x, fresh, kept, d_states, gradients) -> None:
        """Adds the gradients of a window, from its end to its beginning and no further."""
        size = self.hidden
        d_after = d_states.transpose(2, 0, 1)
        d_given = np.empty((3 * size, *x.shape), d_states.dtype)
        before, reset = (np.empty((size, *x.shape), d_states.dtype) for _ in range(2))
        d_h = np.zeros((size, x.shape[1]), d_states.dtype)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = kept[t]
            d = d_after[:, t] + d_h
            d_z, d_c = d * (c - h) * z * (1 - z), d * z * (1 - c * c)
            d_rh = self.w["fresh"] @ d_c
            d_given[:size, t], d_given[size : 2 * size, t], d_given[2 * size :, t] = d_z, d_rh * h * r * (1 - r), d_c
            before[:, t], reset[:, t] = h, r * h
            d_h = d * (1 - z) + d_rh * r + self.w["gates"] @ d_given[: 2 * size, t]
            d_h[:, fresh[t]] = 0
        flat = d_given.reshape(3 * size, -1)
        gradients["gates"] += before.reshape(size, -1) @ flat[: 2 * size].T
        gradients["fresh"] += reset.reshape(size, -1) @ flat[2 * size :].T
        n = len(gradients["inputs"])
        for k, row in enumerate(flat):
            gradients["inputs"][:, k] += np.bincount(x.reshape(-1), weights=row, minlength=n)


def lanes_of(texts: list[np.ndarray], lanes: int) -> list[list[int]]:
    """Texts dealt to lanes, longest first to the lane that is shortest so far."""
    import heapq

    open_lanes = [(0, k) for k in range(min(lanes, len(texts)))]
    out: list[list[int]] = [[] for _ in open_lanes]
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        size, k = heapq.heappop(open_lanes)
        out[k].append(i)
        heapq.heappush(open_lanes, (size + len(texts[i]), k))
    return out


def windows(texts: list[np.ndarray], start: int | np.ndarray, lanes: int = LANES, window: int = WINDOW):
    """``inputs, targets, fresh, owner`` of each window (T, lanes still busy); a text's first input is its ``start``."""
    start = np.broadcast_to(start, max(1, len(texts)))
    dealt = lanes_of(texts, lanes)
    dealt.sort(key=lambda lane: -sum(len(texts[i]) for i in lane))
    sizes = np.array([sum(len(texts[i]) for i in lane) for lane in dealt], np.int64)
    longest = int(sizes[0]) if len(sizes) else 0
    # The row before the first stands for what came before.
    y = np.full((longest + 1, len(dealt)), -1, np.int32)
    owner = np.full((longest + 1, len(dealt)), -1, np.int32)
    for k, lane in enumerate(dealt):
        y[1 : sizes[k] + 1, k] = np.concatenate([texts[i] for i in lane])
        owner[1 : sizes[k] + 1, k] = np.repeat(lane, [len(texts[i]) for i in lane])
    for at in range(0, longest, window):
        busy = int(np.count_nonzero(sizes > at))
        now, before = slice(at + 1, at + window + 1), slice(at, min(at + window, longest))
        fresh = (owner[now, :busy] != owner[before, :busy]) & (owner[now, :busy] >= 0)
        x = np.where(fresh | (y[now, :busy] < 0), start[owner[now, :busy]], y[before, :busy])
        yield x, y[now, :busy], fresh, owner[now, :busy]


@dataclass
class Learner:
    """A network with the running means of Adam; the means of several learners are one, too."""

    network: Network
    m: dict[str, np.ndarray]
    s: dict[str, np.ndarray]
    step: int = 0

    @staticmethod
    def new(network: Network) -> Learner:
        zero = {k: np.zeros_like(v) for k, v in network.w.items()}
        return Learner(network, zero, {k: v.copy() for k, v in zero.items()})

    def state(self) -> np.ndarray:
        """All numbers of the learner in a row."""
        parts = [d[k].reshape(-1) for d in (self.network.w, self.m, self.s) for k in sorted(d)]
        return np.concatenate([*parts, [self.step]]).astype(np.float32)

    def with_state(self, state: np.ndarray) -> Learner:
        at, out = 0, []
        for d in (self.network.w, self.m, self.s):
            out.append({})
            for k in sorted(d):
                out[-1][k] = state[at : at + d[k].size].reshape(d[k].shape).astype(np.float32)
                at += d[k].size
        w, m, s = out
        return Learner(Network(w, self.network.bounds, self.network.n_outputs), m, s, round(float(state[at])))

    def learn(self, texts: list[np.ndarray], starts: int | np.ndarray, lanes: int = LANES) -> None:
        """Adam on the mean loss of each window, gradients cut at its borders, states carried over them."""
        network = self.network
        h = np.zeros((0, network.hidden), np.float32)
        for x, y, fresh, _ in windows(texts, starts, lanes):
            h = h[: x.shape[1]] if len(h) >= x.shape[1] else np.zeros((x.shape[1], network.hidden), np.float32)
            states, h, kept = network.forward(x, h, fresh, keep=True)
            gradients = {k: np.zeros_like(v) for k, v in network.w.items()}
            real = np.flatnonzero(y.reshape(-1) >= 0)
            flat = states.transpose(2, 0, 1).reshape(network.hidden, -1)
            _, back = network._by_class(flat, y.reshape(-1), real, gradients)
            network.backward(x, fresh, kept, back.reshape(-1, *x.shape).transpose(1, 2, 0), gradients)
            self.step += 1
            for k, g in gradients.items():
                g /= len(real)
                np.clip(g, -CLIP, CLIP, out=g)
                self.m[k] += 0.1 * (g - self.m[k])
                self.s[k] += 0.001 * (g * g - self.s[k])
                up = np.sqrt(self.s[k])
                up *= (1 - 0.999**self.step) ** -0.5
                up += 1e-8
                np.divide(self.m[k], up, out=up)
                up *= RATE / (1 - 0.9**self.step)
                network.w[k] -= up


def score_texts(texts: list[np.ndarray], network: Network) -> np.ndarray:
    """log10 probability of each text's outputs, over all its windows."""
    out = np.zeros(len(texts))
    h = np.zeros((0, network.hidden), np.float32)
    for x, y, fresh, owner in windows(texts, network.n_outputs):
        h = h[: x.shape[1]] if len(h) >= x.shape[1] else np.zeros((x.shape[1], network.hidden), np.float32)
        states, h, _ = network.forward(x, h, fresh)
        real = np.flatnonzero(y.reshape(-1) >= 0)
        flat = states.transpose(2, 0, 1).reshape(network.hidden, -1)
        logs, _ = network._by_class(flat, y.reshape(-1), real)
        out += np.bincount(owner.reshape(-1)[real], weights=logs[real], minlength=len(texts))
    return out / math.log(10)


def pieces(texts: list[np.ndarray], start: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The texts in parts of ``PIECE`` tokens, and what stands before each part."""
    cut = [(t, a) for t in texts for a in range(0, len(t), PIECE)]
    return [t[a : a + PIECE] for t, a in cut], np.array([t[a - 1] if a else start for t, a in cut], np.int32)


def grouped(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with bounded numbers of rows and tokens, and their outputs."""
    for batch in batches:
        texts = [np.frombuffer(o, np.uint16) for o in batch.column(column).to_pylist()]
        first = size = 0
        for i, text in enumerate(texts):
            if i > first and (i - first >= GROUP_ROWS or size + len(text) > GROUP_TOKENS):
                yield batch.slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += len(text)
        if first < len(texts):
            yield batch.slice(first), texts[first:]


def train(coded: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Network:
    """A network fitted on all rows of ``coded`` (``row, outputs``), the mean of its learners after each round."""
    learner = Learner.new(Network.new(counts.vocabulary, np.maximum(counts.shape_tokens, 0)))
    passes = int(np.clip(-(-LEAST_TOKENS // max(1, counts.total)), 1, MOST_PASSES)) if counts.total else 0
    tasks = max(1, counts.total // (rounds * TASK_TOKENS))
    for _ in range(passes):
        for part in range(rounds):
            learner = _round(coded.filter(F.pmod("row", F.lit(rounds)) == part), learner, tasks)
    return learner.network


def _round(coded: DataFrame, learner: Learner, tasks: int) -> Learner:
    """The mean of what the tasks' learners know after their rows, by the tokens each has seen."""

    def run(batches):
        own = learner.with_state(learner.state())
        seen, last = 0, None
        for some, texts in grouped(batches, 1):
            last = some.column(0)[0].as_py()
            own.learn(*pieces(texts, own.network.n_outputs))
            seen += sum(map(len, texts))
        if seen:
            state = own.state()
            cut = range(0, len(state), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(cut)), pa.int32()),
                    pa.array([last] * len(cut), pa.int64()),
                    pa.array([seen] * len(cut), pa.int64()),
                    pa.array([state[a : a + BLOCK].tobytes() for a in cut], pa.binary()),
                ],
                names=["block", "learner", "tokens", "numbers"],
            )

    def mean(rows: pa.Table) -> pa.Table:
        # In the order of the learners, so the sum is the same each time.
        total = None
        rows = rows.sort_by("learner")
        tokens = rows.column("tokens").to_pylist()
        for n, numbers in zip(tokens, rows.column("numbers"), strict=True):
            share = np.frombuffer(numbers.as_py(), np.float32) * (n / sum(tokens))
            total = share if total is None else total + share
        return pa.table({"block": rows.column("block")[:1], "numbers": [total.astype(np.float32).tobytes()]})

    learned = coded.select("row", "outputs").coalesce(tasks)
    learned = learned.mapInArrow(run, "block int, learner bigint, tokens bigint, numbers binary")
    blocks = learned.groupBy("block").applyInArrow(mean, "block int, numbers binary").collect()
    if not blocks:
        return learner
    blocks.sort(key=lambda r: r["block"])
    return learner.with_state(np.frombuffer(b"".join(r["numbers"] for r in blocks), np.float32))


def _rare(unknown: np.ndarray, kinds: np.ndarray, edges: np.ndarray) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    """``h, shape, n`` of the words of each text that are not known, the texts' edges in them, and their tokens."""
    where = np.flatnonzero(unknown)
    owner = np.searchsorted(edges, where, side="right") - 1
    h, kind = unknown[where], kinds[where].astype(np.int64)
    order = np.lexsort((kind, h, owner))
    h, kind, own = h[order], kind[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (kind[1:] != kind[:-1]) | (own[1:] != own[:-1])
    firsts = np.flatnonzero(new)
    n = np.diff(np.append(firsts, len(h)))
    found = [pa.array(h[firsts]), pa.array(kind[firsts].astype(np.int32)), pa.array(n.astype(np.int64))]
    rare = pa.StructArray.from_arrays(found, names=["h", "shape", "n"])
    return rare, np.searchsorted(own[firsts], np.arange(len(edges))).astype(np.int32), np.bincount(owner, minlength=len(edges) - 1)


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row."""
    held = remainder_of_crc32("doc_id", MODULUS) == HELD_OUT
    picked = docs.select("doc_id", "text")
    training = picked.filter(~held)
    counted = written(count_words(training), "word-counts")
    counts = known_counts(counted)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = Coder(counts)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, CODED_ROWS):
                some = batch.slice(at, CODED_ROWS)
                words = list(byte_tokens(some.column(1)))
                n = len(words)
                edges = np.concatenate(([0], np.cumsum([len(w) for w in words])))
                outputs, unknown, base, inside = coder.coded(list(chain.from_iterable(words)))
                # Few thousand outputs, whatever the input.
                raw = outputs.astype(np.uint16).tobytes()
                cut = list(pairwise(edges.tolist()))
                rare, rare_edges, n_unknown = _rare(unknown, outputs - coder.size, edges)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(seq, seq + n) + (part << 40), pa.int64()),
                        some.column(0),
                        pa.array(np.diff(edges)),
                        pa.array(np.diff(edges) - n_unknown),
                        pa.array([float(base[a:b].sum()) for a, b in cut], pa.float64()),
                        pa.array([float(inside[a:b].sum()) for a, b in cut], pa.float64()),
                        pa.array([raw[2 * a : 2 * b] for a, b in cut], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(rare_edges, pa.int32()), rare),
                    ],
                    names=["row", "doc_id", "n_tokens", "known", "base", "inside", "outputs", "rare"],
                )
                seq += n

    schema = f"row bigint, doc_id {kind}, n_tokens bigint, known bigint, base double, inside double, outputs binary"
    # Written once, so the row numbers stay what they are.
    coded = picked.mapInArrow(run, f"{schema}, rare array<struct<h:bigint,shape:int,n:bigint>>")
    coded = written(coded, "lm-tokens")
    network = train(coded.filter(~held), counts)

    def score(batches):
        for some, texts in grouped(batches, 6):
            own = score_texts(texts, network) + some.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array(own)], names=[*some.schema.names[:5], "own"])

    scored = coded.drop("rare").mapInArrow(score, schema.replace("inside double, outputs binary", "own double"))
    rare = coded.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.shape", "x.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    total = counts.total + 0.1 * (counts.distinct + 1)
    inside = F.array(*[F.lit(float(t + 0.1 * (v + 1))) for t, v in zip(counts.shape_tokens, counts.shape_words, strict=True)])
    # Words that a third of the rows hold are frequent and known to the tasks; what is joined here is rare.
    later = (
        rare.join(counted.select("h", "c"), "h", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10((c + 0.1) / F.lit(total))).alias("more_base"),
            F.sum(F.col("n") * F.log10((c + 0.1) / F.get(inside, F.col("shape")))).alias("more_own"),
        )
    )
    out = scored.join(later, "row", "left")
    zero = F.lit(0.0)
    # The end counts as known once it has been seen in training.
    unseen_end = F.lit(0 if counts.total else 1)
    return out.select(
        "doc_id",
        (remainder_of_crc32("doc_id", MODULUS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") - unseen_end + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("more_own", zero)).alias("score"),
    )
