"""SentencePiece encoding and decoding of merge-type vocabularies.

The vocabulary is read from the model file; merging is done here with an agenda
of adjacent symbol pairs, best score first and leftmost among equals. The
library encodes every part of a text that a worker has not met before, in the
same Arrow batch, and a difference raises.

Spaces become U+2581 and no vocabulary piece holds one after another character,
so merging never crosses the start of a word. The text is therefore encoded
word by word and words seen before come from a bounded cache; the result is the
same as merging over the whole text.

Null and empty texts have no ids besides the end id. Repeated rows give repeated
results; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from sluicebox.llm.common import BoundedCache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_ENTRIES = 400_000
#: Parts of up to this many characters keep their agenda as a list, longer ones as a heap.
WORD_SYMBOLS = 48
#: Order of a pair that is no piece.
NEVER = float("inf")
#: A run of U+2581 with the word behind it, or a line feed with the word behind it.
RUNS = re.compile(f"\n[^{SPACE}]*|{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind} in the model file")


class Vocabulary:
    """Pieces, scores and kinds of a merge-type model with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = file.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("only merge-type models are read here")
        if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that keep the text, add a leading space and escape spaces are read here")
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not read here")
        self.ids = {p: (-scores[i], i) for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.order = {p: order for p, (order, _) in self.ids.items()}
        self.names = [str(i) for i in range(len(self.pieces))]
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        self.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("only models with byte fallback are read here")
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long) or any("\n" in p for p in long):
            raise ValueError("a piece of this model crosses words or lines")
        # Marks that no piece holds after a letter or digit: nothing merges across that place.
        self.closing = {c for c in ".,!?;:" if not any(re.search(rf"[^\W_]{re.escape(c)}", p) for p in long)}
        self.surface = [self._surface(i) for i in range(len(self.pieces))]

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(SPACE, " ").encode()

    def merge(self, text: str) -> tuple[int, ...]:
        """Ids of ``text`` (spaces already U+2581) by the agenda of adjacent pairs."""
        symbols = self._merge_word(text) if len(text) <= WORD_SYMBOLS else self._merge_long(text)
        out: list[int] = []
        for symbol in symbols:
            if found := self.ids.get(symbol):
                out.append(found[1])
            else:
                out.extend(self.byte_ids[b] for b in symbol.encode())
        return tuple(out)

    def _merge_word(self, text: str) -> list[str]:
        """The agenda as a list in the order of the text: its least entry, the leftmost of equals, is next."""
        order = self.order.get
        symbols = list(text)
        agenda = [order(text[i : i + 2], NEVER) for i in range(len(text) - 1)]
        while agenda and (least := min(agenda)) != NEVER:
            at = agenda.index(least)
            del agenda[at]
            pair = symbols[at] = symbols[at] + symbols.pop(at + 1)
            if at < len(agenda):
                agenda[at] = order(pair + symbols[at + 1], NEVER)
            if at:
                agenda[at - 1] = order(symbols[at - 1] + pair, NEVER)
        return symbols

    def _merge_long(self, text: str) -> list[str]:
        """The agenda as a heap by score, then place; stale entries are skipped."""
        ids = self.ids
        symbols: list[str] = list(text)
        n = len(symbols)
        before = list(range(-1, n - 1))
        behind = list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if found := ids.get(pair):
                agenda.append((found[0], i, i + 1, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, left, right, pair = pop(agenda)
            # Stale when either side has been merged since.
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after = behind[left] = behind[right]
            if after < n:
                before[after] = left
                longer = pair + symbols[after]
                if found := ids.get(longer):
                    push(agenda, (found[0], left, after, longer))
            if (first := before[left]) >= 0:
                longer = symbols[first] + pair
                if found := ids.get(longer):
                    push(agenda, (found[0], first, left, longer))
        return [symbol for symbol in symbols if symbol]

    def split(self, text: str) -> list[str]:
        """The parts of a whole text between which nothing can merge.

        A part is a word that stands after one space, or begins with U+2581 for
        each further space, or begins with the line feed it follows.
        """
        if not text:
            return []
        marked = text.replace("\n", " \n")
        if marked[0] != " " and marked[-1] != " " and "  " not in marked and SPACE not in marked:
            return marked.split(" ")
        # Every space that does not just precede one word is kept as U+2581 inside a part.
        parts: list[str] = []
        for k, line in enumerate(text.split("\n")):
            escaped = ("\n" if k else SPACE) + line.replace(" ", SPACE)
            found = RUNS.findall(escaped)
            parts += [p[1:] if p[0] == SPACE and p[1:2] not in ("", SPACE) else p for p in found]
        return parts

    def part_ids(self, part: str) -> tuple[int, ...]:
        """Ids of one part; only its first character says whether a space precedes it."""
        if part[0] == "\n":
            rest = part[1:]
            return (self.byte_ids[10], *self.merge(rest)) if rest else (self.byte_ids[10],)
        return self.merge(part if part[0] == SPACE else SPACE + part)

    def decode(self, ids) -> str:
        """The text of ``ids``, without the leading space that encoding adds."""
        surface = self.surface
        data = b"".join(map(surface.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class Codec:
    """Encodes whole texts through a bounded cache; the library checks what it has not seen before."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        self.vocabulary = Vocabulary(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache: dict[str, tuple[int, ...]] = BoundedCache(cache_entries)

    def learn(self, parts: set[str]) -> None:
        """Merge new parts and hold them against the library, in one text with a line feed between."""
        new = sorted(parts)
        v, cache = self.vocabulary, self.cache
        cache.make_room(len(new))
        for part in new:
            if part[-1] in v.closing and len(part) > 1 and part[-2].isalnum():
                # A closing mark merges with nothing before it, so the word itself may be known.
                start = cache.get(part[:-1])
                ids = (start or v.part_ids(part[:-1])) + v.merge(part[-1])
            else:
                ids = v.part_ids(part)
            cache[part] = ids
        given = "".join(p if p[0] == "\n" else "\n" + (p if p[0] == SPACE else SPACE + p) for p in new)
        want = self.library.encode(given.replace(SPACE, " "))
        feed = v.byte_ids[10]
        got = list(v.merge(SPACE))
        for part in new:
            if part[0] != "\n":
                got.append(feed)
            got.extend(cache[part])
        if got != want:
            raise ValueError("merging differs from the library within " + repr(new)[:500])

    def entries(self, text: str) -> list[tuple[int, ...]]:
        parts = self.vocabulary.split(text)
        found = list(map(self.cache.get, parts))
        if None in found:
            kept = dict(zip(parts, found, strict=True))
            self.learn({p for p, e in kept.items() if e is None})
            cache = self.cache
            found = [e or cache.get(p) or kept[p] for p, e in zip(parts, found, strict=True)]
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.entries(text)))


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, cache_entries: int = CACHE_ENTRIES) -> Codec:
    """One codec per Python worker: workers outlive tasks, and so does the cache."""
    if (path, cache_entries) not in _CODECS:
        _CODECS[path, cache_entries] = Codec(path, cache_entries)
    return _CODECS[path, cache_entries]


def digest(coder: Codec, text: str) -> tuple[list[int], str, str, str]:
    """The ids with the end id, SHA-256 of the ids as text, the decoded text and its SHA-256."""
    ids = coder.encode(text)
    ids.append(coder.vocabulary.end)
    said = " ".join(map(coder.vocabulary.names.__getitem__, ids))
    decoded = coder.vocabulary.decode(ids)
    return ids, _sha(said), decoded, _sha(decoded)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def encode_documents(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True
) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256, ids, decoded`` for each row of ``docs``.

    ``ids`` end with the end id; ``keep_ids=False`` leaves out the two wide
    columns. Nothing is shuffled: the work is a map over Arrow batches.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    wide = ", ids array<int>, decoded string" if keep_ids else ""
    schema = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{wide}"

    def run(batches):
        coder = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [digest(coder, t or "") for t in some.column(1).to_pylist()]
                columns = [
                    some.column(0),
                    pa.array([len(f[0]) for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.string()),
                    pa.array([f[3] for f in found], pa.string()),
                ]
                names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [
                        pa.array([f[0] for f in found], pa.list_(pa.int32())),
                        pa.array([f[2] for f in found], pa.string()),
                    ]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)
