"""Token ids in binary files: frequency ranks, byte-aligned, control bytes apart.

``write_token_files`` encodes whole texts with a ``tokenizers`` vocabulary, puts
an end id behind each document and writes the ids in ascending ``doc_id`` order.
An id is replaced by its rank among all ids of all documents (most frequent
first, smaller id first among equals), so frequent ids take one byte. Four ranks
share a control byte that holds their lengths, two bits each (1 to 4 bytes);
control bytes and data bytes stand apart. Decoding takes the lengths of four
ranks at once from a 256-row table and gathers the bytes with numpy.

A folder holds ``ranks.bin`` (ids in rank order, little-endian uint32), one file
per range of documents, and a manifest table with path, first position and
counts of each file. A file is a run of blocks: a head (magic, number of
documents, ids, data bytes), the document ids, their token counts, the control
bytes, the data bytes.

Null and empty texts have the end id alone. A null ``doc_id`` sorts first. Rows
with the same ``doc_id`` are ordered by their text's hash and all kept. An empty
table gives no files and an empty result. Other columns are not read.
"""

from __future__ import annotations

import codecs
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.llm import files
from sluicebox.llm.common import BoundedCache, tasks_for, written
from sluicebox.session import scratch_dir

MAGIC = b"RVB1"
HEAD = struct.Struct("<4sIQQ")
NO_ID = -(2**63)
BLOCK_IDS = 1 << 20
CACHE_ENTRIES = 800_000
#: Marks that may stand between words that are encoded in one text, and words of such a text.
MARKS, JOINED = "§¶†‡¤|~^", 256
#: Characters of the texts that are split at a time.
GROUP_CHARS = 1 << 21
#: Letters of Latin-1, and marks of ASCII without the apostrophe, which may begin a part of its own.
LETTERS = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]) if c not in "×÷")
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: What a vocabulary does before it merges, if letters and signs need no more than small letters for capitals.
PLAIN_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PLAIN_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_letters() -> str:
    """The letter of each byte in byte-level vocabularies."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in seen or b == 32 else next(others) + (b > 32)) for b in range(256))


def _gathered(numbers: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``which`` of ``numbers``, whose runs have the given lengths, and where each begins, with the end."""
    n = length[which]
    edges = np.concatenate(([0], np.cumsum(n)))
    shift = (np.cumsum(length) - length)[which] - edges[:-1]
    return numbers[np.repeat(shift, n) + np.arange(edges[-1])], edges


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file, word by word through a bounded cache.

    The vocabulary drops white space and never joins what stands on both sides
    of a space or a line feed, so each such part may be encoded once and kept, and
    many new ones in one text with a mark between them, where the mark has an id
    that none of them has. Where a part is letters with signs behind them, and the
    file says what these need before their letters are merged, both are kept apart,
    and the library merges the small letters with its other steps left out; the id
    that ends a word tells them apart.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache: BoundedCache = BoundedCache(cache_entries)
        unknown = set(self.ids(["\U0010FFFF"])[0])
        alone = ((c, self.ids([c])[0]) for c in MARKS)
        self.mark, self.mark_id = next(((c, got[0]) for c, got in alone if len(got) == 1 and got[0] not in unknown), (None, None))
        self.merger = None
        form = json.loads(self.library.to_str())
        model = form["model"]
        ending = model.get("end_of_word_suffix")
        known = form["normalizer"] == PLAIN_NORMALIZER and form["pre_tokenizer"] == PLAIN_SPLIT
        if known and model["type"] == "BPE" and ending and form["post_processor"] is None:
            split = {"type": "CharDelimiterSplit", "delimiter": " "}
            self.merger = Tokenizer.from_str(json.dumps(form | {"normalizer": None, "pre_tokenizer": split, "added_tokens": []}))
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(ending)]] = True
            self.spelling = _byte_letters()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [got.ids for got in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes."""
        if self.mark is None:
            return [np.array(ids, np.uint32).tobytes() for ids in self.ids(words)]
        out: list[bytes] = []
        parts = [words[a : a + JOINED] for a in range(0, len(words), JOINED)]
        for part, ids in zip(parts, self.ids([f" {self.mark} ".join(part) for part in parts]), strict=True):
            found = np.array(ids, np.uint32)
            at = np.flatnonzero(found == self.mark_id)
            if len(at) == len(part) - 1:
                raw, ends = found.tobytes(), (4 * at).tolist()
                starts = [0, *[e + 4 for e in ends]]
                out += [raw[a:b] for a, b in zip(starts, [*ends, len(raw)], strict=True)]
            else:
                # One of the words holds the mark's own id.
                out += [np.array(ids, np.uint32).tobytes() for ids in self.ids(part)]
        return out

    def merged(self, words: list[str]) -> list[bytes]:
        """As ``each``, of words of small Latin-1 letters."""
        out: list[bytes] = []
        for a in range(0, len(words), JOINED):
            part = words[a : a + JOINED]
            text = codecs.charmap_decode(" ".join(part).encode(), "strict", self.spelling)[0]
            got = self.merger.encode_batch_fast([text], add_special_tokens=False)
            found = np.array(got[0].ids, np.uint32)
            ends = (4 * np.flatnonzero(self.ends[found]) + 4).tolist()
            if len(ends) == len(part):
                raw = found.tobytes()
                out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                # A letter is not in the vocabulary.
                out += self.each(part)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for ids, counts in self.encode_column(pa.array(texts, pa.string())):
            out += np.split(ids, np.cumsum(counts)[:-1])
        return out

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All ids, and how many each text has, of about ``GROUP_CHARS`` of texts after the other.

        Each distinct part of such a group is looked up once.
        """
        sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(texts):
            before = sizes[first - 1] if first else 0
            behind = max(first + 1, int(np.searchsorted(sizes, before + GROUP_CHARS, "right")))
            group = pc.split_pattern(pc.replace_substring(texts.slice(first, behind - first), "\n", " "), " ")
            parts = group.flatten().dictionary_encode()
            ids, edges = _gathered(*self.known(parts.dictionary), parts.indices.to_numpy())
            at = edges[group.offsets.to_numpy()]
            yield ids, np.diff(at)
            first = behind

    def known(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts one after the other, and how many each has."""
        if self.merger is None:
            return self.looked_up(parts, parts.slice(0, 0))
        behind = pc.utf8_ltrim(parts, LETTERS)
        plain = pc.equal(pc.utf8_ltrim(behind, SIGNS), "")
        words = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(parts, SIGNS)), parts).dictionary_encode()
        signs = pc.if_else(plain, behind, "").dictionary_encode()
        ids, length = self.looked_up(words.dictionary, signs.dictionary)
        both = np.stack([words.indices.to_numpy(), signs.indices.to_numpy() + len(words.dictionary)], axis=1)
        ids, edges = _gathered(ids, length, both.reshape(-1))
        return ids, np.diff(edges[::2])

    def looked_up(self, words: pa.Array, signs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and signs (each once) by the cache; the library encodes those not met before."""
        names = [*words.to_numpy(zero_copy_only=False), *signs.to_numpy(zero_copy_only=False)]
        cache = self.cache
        found = list(map(cache.get, names))
        new = [i for i, ids in enumerate(found) if ids is None]
        # These are at hand already, so a cache that starts anew loses none of them.
        cache.make_room(len(new))
        plain = pc.equal(pc.utf8_ltrim(words, LETTERS), "").to_pylist() if self.merger else []
        for encode, some in (
            (self.merged, [i for i in new if i < len(plain) and plain[i] and names[i]]),
            (self.each, [i for i in new if i >= len(plain) or not plain[i] or not names[i]]),
        ):
            asked = [names[i] for i in some]
            for i, name, ids in zip(some, asked, encode(asked), strict=True):
                found[i] = cache[name] = ids
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), length


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# Bytes of the four numbers behind each control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_TOTALS = _LENGTHS.sum(axis=1)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    numbers = numbers.astype("<u4")
    size = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[: len(numbers)] = size - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), numbers.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers: lengths by table lookup on the control bytes, then one gather."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int64)
    if n and end[-1] != len(data):
        raise ValueError(f"control bytes tell of {end[-1]} data bytes, there are {len(data)}")
    cells = np.zeros((n, 4), np.uint8)
    cells[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return cells.view("<u4").reshape(-1)


def write_block(out, doc_ids: list[int], counts: list[int], ranks: np.ndarray) -> None:
    control, data = pack(ranks)
    out.write(HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data)))
    out.write(np.array(doc_ids, "<i8").tobytes())
    out.write(np.array(counts, "<u4").tobytes())
    out.write(control)
    out.write(data)


def read_blocks(file) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``doc_ids, counts, ranks`` of each block; a cut or damaged file raises."""

    def exactly(n: int) -> bytes:
        got = file.read(n)
        if len(got) != n:
            raise ValueError(f"the file ends {n - len(got)} bytes early")
        return got

    while head := file.read(HEAD.size):
        if len(head) != HEAD.size:
            raise ValueError("the file ends within a head")
        magic, n_docs, n_ids, n_data = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        doc_ids = np.frombuffer(exactly(8 * n_docs), "<i8")
        counts = np.frombuffer(exactly(4 * n_docs), "<u4")
        ranks = unpack(exactly(-(-n_ids // 4)), exactly(n_data), n_ids)
        if int(counts.sum(dtype=np.int64)) != n_ids:
            raise ValueError("the documents' counts do not add up")
        yield doc_ids, counts, ranks


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """``part, seq, doc_id, n, ids``: ids as bytes in document order, parts ascending."""

    def run(batches):
        code = encoder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, at = batch.column(0).cast(pa.int64()), 0
            for ids, counts in code.encode_column(batch.column(1).fill_null("")):
                n = len(counts)
                edges = np.concatenate(([0], np.cumsum(counts)))
                ids = np.insert(ids, edges[1:], end_id)
                wide = "<u2" if ids.max() < 65536 else "<u4"
                data = ids.astype(wide).tobytes()
                places = pa.array((edges + np.arange(n + 1)) * np.dtype(wide).itemsize, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.arange(seq, seq + n)),
                        doc_ids.slice(at, n),
                        pa.array(counts + 1),
                        pa.Array.from_buffers(pa.binary(), n, [None, places.buffers()[1], pa.py_buffer(data)]),
                    ],
                    names=["part", "seq", "doc_id", "n", "ids"],
                )
                at, seq = at + n, seq + n

    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    # The hash only orders rows that share a doc_id, and lets such a mass be dealt to several ranges.
    tie = F.xxhash64("text")
    dealt = picked.repartitionByRange(tasks_for(docs), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return dealt.mapInArrow(run, "part int, seq bigint, doc_id bigint, n bigint, ids binary")


def _numbers(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def rank_table(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """All ids of the vocabulary, most frequent first; counted over all rows.

    Each task sends one count per id it met, at most ``vocabulary`` rows; the
    driver gets one row per id, so its table is bounded by the vocabulary.
    """

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount(_numbers(ids, n), minlength=vocabulary)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["id", "n"])

    counted = tokens.select("n", "ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in counted.collect():
        counts[row["id"]] = row["n"]
    return np.lexsort((np.arange(vocabulary), -counts)).astype("<u4")


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Write the files; returns the manifest ``part, path, n_docs, n_ids, start``."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "token-files")
    files.make_folder(folder)
    tokens = written(_tokenized(docs, tokenizer, end_id, id_column, text_column), "tokens")
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    ranks = rank_table(tokens, vocabulary)
    with files.open_for_writing(f"{folder}/ranks.bin") as out:
        out.write(ranks.tobytes())

    def write(batches):
        rank_of = np.empty(vocabulary, np.uint32)
        rank_of[ranks] = np.arange(vocabulary, dtype=np.uint32)
        part, out, path = None, None, None
        doc_ids: list[int] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        waiting = n_docs = n_ids = 0
        rows = []

        def flush():
            nonlocal waiting
            if doc_ids:
                write_block(out, doc_ids, counts, rank_of[np.concatenate(parts)])
                doc_ids.clear(), counts.clear(), parts.clear()
                waiting = 0

        def close():
            if out is not None:
                flush()
                out.close()
                rows.append((part, first, path, n_docs, n_ids))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for p, seq, doc_id, n, ids in zip(*columns, strict=True):
                if p != part or seq != last + 1:
                    close()
                    part, first, n_docs, n_ids = p, seq, 0, 0
                    path = files.attempt_name(folder, p, ".rvb")
                    out = files.open_for_writing(path)
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                counts.append(n)
                parts.append(_numbers(ids, n))
                waiting, n_docs, n_ids, last = waiting + n, n_docs + 1, n_ids + n, seq
                if waiting >= BLOCK_IDS:
                    flush()
        close()
        if rows:
            names = ["part", "first", "path", "n_docs", "n_ids"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _MANIFEST)

    # A file of the token table holds rows of one part in order; a split of it begins where another ends.
    schema = "part int, first bigint, path string, n_docs bigint, n_ids bigint"
    manifest = written(tokens.mapInArrow(write, schema), "token-manifest")
    # One row per file: what must be in order here is a few bytes for each of them.
    order = Window.orderBy("part", "first").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


_MANIFEST = pa.schema(
    [
        ("part", pa.int32()),
        ("first", pa.int64()),
        ("path", pa.string()),
        ("n_docs", pa.int64()),
        ("n_ids", pa.int64()),
    ]
)


def read_token_files(manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` of each document, decoded from the files."""
    wide = ", ids array<int>" if keep_ids else ""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                folder = row["path"].rsplit("/", 1)[0]
                with files.open_for_reading(f"{folder}/ranks.bin") as file:
                    by_rank = np.frombuffer(file.read(), "<u4")
                start = row["start"]
                seen = 0
                with files.open_for_reading(row["path"]) as file:
                    for doc_ids, counts, ranks in read_blocks(file):
                        ids = by_rank[ranks]
                        edges = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                        cut = list(zip(edges[:-1], edges[1:], strict=True))
                        columns = [
                            pa.array(doc_ids, mask=doc_ids == NO_ID),
                            pa.array(start + edges[:-1], pa.int64()),
                            pa.array(counts.astype(np.int64)),
                            pa.array([zlib.crc32(ids[a:b]) for a, b in cut], pa.int64()),
                        ]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if keep_ids:
                            columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in cut], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        start += int(edges[-1])
                        seen += len(doc_ids)
                if seen != row["n_docs"] or start != row["start"] + row["n_ids"]:
                    raise ValueError(f"{row['path']} does not hold what its manifest row says")

    # Each file is a task's work, whatever the size of the manifest.
    dealt = manifest.repartition(max(1, manifest.count()))
    return dealt.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint{wide}")
