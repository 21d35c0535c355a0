"""SentencePiece, token files, archives: against the libraries and by round trip."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicebox.llm import files, tokenfile, warc
from sluicebox.llm.sentencepiece import codec, digest, encode_documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [" ", "  ", "\n", "\t", "a", "the", ".", ",", "!", "é", "́", "▁", "🙂", "</s>", "<|endoftext|>", "'s", "1", "\x1c", "\xa0"]


def odd_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_pieces_are_those_of_the_library():
    library, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), codec(PIECES)
    for text in odd_texts(800):
        ids, _, decoded, _ = digest(mine, text)
        assert ids == library.encode(text, add_eos=True)
        assert decoded == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_comes_back(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    library, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), codec(PIECES)
    assert digest(mine, text)[0] == library.encode(text, add_eos=True)


def test_both_agendas_merge_alike():
    vocabulary = codec(PIECES).vocabulary
    rng = random.Random(9)
    for _ in range(3000):
        text = "▁" + "".join(rng.choice("aeinrsthé.#中▁1") for _ in range(rng.randint(0, 70)))
        assert vocabulary._merge_word(text) == vocabulary._merge_long(text)
    assert vocabulary._merge_word("") == vocabulary._merge_long("") == []


def test_encoding_odd_rows(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for row, source in zip(encode_documents(odd, PIECES).collect(), odd.collect(), strict=True):
        ids = library.encode(source["text"] or "", add_eos=True)
        assert row["doc_id"] == source["doc_id"] and list(row["ids"]) == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode_documents(none, PIECES).count() == 0


def test_words_are_those_of_the_library():
    library, mine = Tokenizer.from_file(WORDS), tokenfile.WordEncoder(WORDS)
    for text in odd_texts(1500):
        assert list(mine.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_many_new_words_are_few_calls_of_the_library(monkeypatch):
    library, mine = Tokenizer.from_file(WORDS), tokenfile.WordEncoder(WORDS)
    assert mine.mark is not None
    asked = []
    own = mine.ids
    monkeypatch.setattr(mine, "ids", lambda texts: asked.append(len(texts)) or own(texts))
    texts = [" ".join(f"wo{i}rd{k} a{i}b." for k in range(50)) for i in range(40)]
    got = mine.encode_all(texts)
    assert sum(asked) < 20
    # A word that holds the mark, too; and a cache that is cleared between and within groups.
    texts += [f"some {mine.mark} x{mine.mark}y, {mine.mark}{mine.mark}", "", "  ", f"é{mine.mark}.\n7."]
    got += mine.encode_all(texts[40:])
    monkeypatch.setattr(tokenfile, "GROUP_CHARS", 500)
    small = tokenfile.WordEncoder(WORDS, cache_entries=30)
    for text, ids, again in zip(texts, got, small.encode_all(texts), strict=True):
        assert ids.tolist() == again.tolist() == library.encode(text, add_special_tokens=False).ids


def test_letters_are_merged_without_the_other_steps_of_the_library(monkeypatch):
    library, mine = Tokenizer.from_file(WORDS), tokenfile.WordEncoder(WORDS)
    asked = []
    own = mine.ids
    monkeypatch.setattr(mine, "ids", lambda texts: asked.extend(texts) or own(texts))
    texts = [" ".join(f"{a}{b}{c}" for a in ("Straße", "ÀÿÐ", "Íllñ", "xyz") for b in ("que", "Öb", "") for c in ("", ".", "&&&", "_|"))]
    odd = ["don't we'll 'tis it's. ..'s a'", "ªbc µm 1a a1, ×y Ÿa İI ΣΑΣ K\u212a e\u0301, <\u0338 <|endoftext|> a<|endoftext|>", "a\tb\u00a0c\x1cd \u2028"]
    got = mine.encode_all(texts)
    # Only the signs go through all of the library.
    assert not any(c.isalpha() for c in "".join(asked)) and len("".join(asked)) < 40
    got += mine.encode_all(odd) + mine.encode_all(texts)
    for text, ids in zip(texts + odd + texts, got, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    # Without known steps every part goes through the library.
    mine = tokenfile.WordEncoder(WORDS)
    mine.merger = None
    for text, ids in zip(texts + odd, mine.encode_all(texts + odd), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_packing_comes_back(numbers):
    control, data = tokenfile.pack(np.array(numbers, np.uint32))
    assert list(tokenfile.unpack(control, data, len(numbers))) == numbers
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, -(-n.bit_length() // 8)) for n in numbers)


def test_token_files_of_odd_rows(odd, none):
    library = Tokenizer.from_file(WORDS)
    got = tokenfile.read_token_files(tokenfile.write_token_files(odd, WORDS, end_id=1)).collect()
    source = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(got) == len(source)
    at = 0
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == at and row["n_tokens"] == len(row["ids"])
        assert row["ids_crc32"] == zlib.crc32(np.array(row["ids"], "<u4").tobytes())
        at += row["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [r["doc_id"] for r in source]
    want = sorted([library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in source])
    assert sorted(list(r["ids"]) for r in got) == want
    assert tokenfile.read_token_files(tokenfile.write_token_files(none, WORDS, end_id=1)).count() == 0


def test_a_cut_token_file_is_noticed(odd):
    manifest = tokenfile.write_token_files(odd, WORDS, end_id=1)
    path = manifest.first()["path"]
    with files.open_for_reading(path) as file:
        data = file.read()
    with files.open_for_writing(path) as out:
        out.write(data[:-3])
    with pytest.raises(Exception, match="bytes early"):
        tokenfile.read_token_files(manifest).collect()


def pages(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i % 40}</p>" * (i % 7)) for i in range(200)]
    rows += [(900, None, None), (None, "http://b", "<p>1</p>"), (901, "http://c/\r\nX: y", ""), (0, "again", "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_archives_come_back(spark):
    df = pages(spark).withColumn("digest", F.col("url")).repartition(2)
    manifest = warc.write_archives(df)
    got = warc.read_archives(manifest).collect()
    source = pages(spark).collect()
    first = {}
    for r in source:
        if r["page_id"] is not None:
            text = r["html"] or ""
            first[text] = min(first.get(text, r["page_id"]), r["page_id"])
    want = []
    for r in source:
        text = r["html"] or ""
        ref = first.get(text) if r["page_id"] is not None and first[text] < r["page_id"] else None
        kind = "response" if ref is None else "revisit"
        want.append((r["page_id"], len(text.encode()), warc.digest_text(text.encode()), kind, ref))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in got)
    with open(manifest.filter("records > 50").first()["path"].removeprefix("file://"), "rb") as file:
        assert int.from_bytes(file.read(4), "little") == warc.DICTIONARY_FRAME
    whole = warc.with_payload(warc.read_archives(manifest)).filter("page_id is not null and record_type = 'revisit'")
    by_id = {r["page_id"]: (r["html"] or "").encode() for r in source}
    assert all(bytes(r["payload"]) == by_id[r["page_id"]] for r in whole.collect())


def test_archives_of_an_empty_table(spark):
    assert warc.read_archives(warc.write_archives(pages(spark).filter("false"))).count() == 0


def test_small_payloads_are_all_responses(spark):
    got = warc.read_archives(warc.write_archives(pages(spark), least_bytes=10_000))
    assert got.filter("record_type != 'response'").count() == 0


@pytest.mark.parametrize(
    ("old", "new", "said"),
    [
        (b"WARC/1.1", b"WARC/9.9", "version"),
        (b"WARC-Date", b"X-Date", "no warc-date"),
        (b"hello", b"hellO", "digest"),
        (b"\r\n\r\n\r\n\r\n", b"\r\n\r\n", "announced"),
        (b"Content-Length: 5\r", b"Content-Length: 6\r", "digest|announced"),
    ],
)
def test_damaged_records_are_refused(old, new, said):
    data = warc.record(1, "http://a", b"hello", None, "2024-01-01T00:00:00Z") + b""
    assert warc.page_of(data)[2] == 5
    spoilt = data[:-4] + b"x" if old.startswith(b"\r\n") else data.replace(old, new, 1)
    with pytest.raises(ValueError, match=said):
        warc.page_of(spoilt)


def test_a_cut_archive_is_noticed(tmp_path):
    path = str(tmp_path / "a.warc.zst")
    with open(path, "wb") as out:
        out.write(zstandard.ZstdCompressor().compress(b"x" * 1000)[:-5])
    with files.open_for_reading(path) as file, pytest.raises(ValueError, match="ends early"):
        list(warc.frames(file, path))
