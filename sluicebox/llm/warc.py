"""Web archives: one Zstandard frame per WARC record, dictionary in the leading skippable frame.

``write_archives`` writes a record for each page and ``read_archives`` reads the
archives back from their manifest. Each archive begins with a skippable frame
(magic 0x184D2A5D) that holds the dictionary trained on the archive's first
records, or with the first record where there are too few to train on.

Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the
smallest ``page_id`` is a response; the others are revisits: HTTP head only, with
the response's record id in ``WARC-Refers-To``. Smaller payloads are always
responses. Rows that share that smallest id and the payload are all responses. A
null ``page_id`` can be referred to by nobody: it is a response and reads back
as null. A null ``html`` is an empty payload. A null ``url`` leaves out the target
header and reads back as null; control characters and spaces in a url are
percent-encoded. An empty table gives no archives. Other columns are not read.

The reader checks the version line, the headers a record must have, block and
payload lengths, the end of each record, and the SHA-1 digests; a fault raises
with the archive's name and the record's number.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm import files
from sluicebox.llm.common import written
from sluicebox.session import scratch_dir

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = ("WARC/1.0", "WARC/1.1")
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

DICTIONARY_BYTES = 64 << 10
#: Records, and bytes of them, that a dictionary is trained on.
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 4 << 20
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 64 << 10


def digest_text(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One whole record: response, or revisit if ``refers_to`` is given."""
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest_text(payload))}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <{name}>"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Date: {date}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest_text(payload)}",
        f"WARC-Block-Digest: sha1:{digest_text(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]):
    """A dictionary, or None where the records are too few or too small for one."""
    import zstandard

    size = min(DICTIONARY_BYTES, sum(map(len, records)) // 8)
    if len(records) < 16 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, records, level=3)
    except zstandard.ZstdError:
        return None


class Archive:
    """Writes records to one file as independent frames behind their dictionary."""

    def __init__(self, path: str, sample: list[bytes], level: int):
        import zstandard

        self.path, self.records, self.bytes = path, 0, 0
        self.out = files.open_for_writing(path)
        dictionary = train(sample)
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(
            level=level, dict_data=dictionary, write_checksum=True, write_content_size=True
        )
        for data in sample:
            self.add(data)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))
        self.records += 1


def frames(file, name: str) -> Iterator[bytes]:
    """The content of each frame; the dictionary is loaded from the leading skippable frame."""
    import zstandard

    data = file.read(READ_BYTES)
    dictionary = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        while len(data) < 8 + size:
            if not (more := file.read(READ_BYTES)):
                raise ValueError(f"{name}: the dictionary frame ends early")
            data += more
        packed, data = data[8 : 8 + size], data[8 + size :]
        if packed[:4] == ZSTD_FRAME:
            packed = zstandard.ZstdDecompressor().decompress(packed)
        dictionary = zstandard.ZstdCompressionDict(packed, dict_type=zstandard.DICT_TYPE_FULLDICT)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := file.read(READ_BYTES)):
        one, out = decompressor.decompressobj(), []
        while True:
            out.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            if not (data := file.read(READ_BYTES)):
                raise ValueError(f"{name}: the last frame ends early")
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a frame that holds exactly one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the headers")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] not in VERSIONS:
        raise ValueError(f"version line {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key or key != key.strip():
            raise ValueError(f"header line {line[:80]!r}")
        if key.lower() in headers:
            raise ValueError(f"header {key} twice")
        headers[key.lower()] = value.strip()
    if missing := [k for k in NEEDED if k not in headers]:
        raise ValueError(f"no {', '.join(missing)}")
    if not re.fullmatch("[0-9]+", headers["content-length"]):
        raise ValueError("content length is not a number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{len(rest) - 4} bytes in the block, {size} announced")
    block = rest[:size]
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{digest_text(block)}":
        raise ValueError("the block digest differs")
    return headers, block


def page_of(data: bytes):
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of a record."""
    headers, block = parse(data)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, found, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?mi)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
    if not found or not http.startswith(b"HTTP/") or not size:
        raise ValueError("no HTTP head with a length")
    size, digest = int(size[1]), headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not digest:
        raise ValueError("no payload digest")
    if kind == "response":
        if size != len(payload):
            raise ValueError(f"{len(payload)} bytes of payload, {size} announced")
        if digest != digest_text(payload):
            raise ValueError("the payload digest differs")
    elif payload:
        raise ValueError("a revisit with a payload")
    elif headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers:
        raise ValueError("a revisit without profile or reference")
    refers = headers.get("warc-refers-to") if kind == "revisit" else None
    return (
        _page_id(headers["warc-record-id"]),
        headers.get("warc-target-uri"),
        size,
        digest,
        kind,
        _page_id(refers) if refers else None,
        payload if kind == "response" else None,
    )


def _page_id(name: str) -> int | None:
    found = re.fullmatch("<urn:page:(-?[0-9]+)>", name)
    return int(found[1]) if found else None


def with_reference(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: the smallest id with the payload, where that is another page.

    Payloads are grouped by digest and length after a partial minimum, so a
    payload that a third of the pages share is one row per task. Only digests of
    more than one page are joined back; a frequent one is a skewed join key that
    adaptive execution splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    base = base.withColumn("digest", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload").cast("string")))
    known = base.filter(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least_bytes))
    first = (
        known.groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .filter("first < last")
        .select("digest", "first")
    )
    joined = base.join(first, "digest", "left")
    return joined.select(
        "page_id", "url", "payload", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3
) -> DataFrame:
    """Write the archives; returns their manifest ``path, records, bytes``.

    Names are new for each attempt of a task and only the manifest says which
    files count, so a task that runs again leaves no record twice.
    """
    folder = scratch_dir(pages.sparkSession, "warc")
    files.make_folder(folder)

    def run(batches):
        part = TaskContext.get().partitionId()
        sample: list[bytes] = []
        held, archive, done = 0, None, []

        def close():
            nonlocal archive, sample, held
            if archive is None and sample:
                archive = Archive(files.attempt_name(folder, part, ".warc.zst"), sample, level)
            if archive is not None:
                archive.out.close()
                done.append((archive.path, archive.records, archive.bytes))
            archive, sample, held = None, [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for row in zip(*(some.column(i).to_pylist() for i in range(4)), strict=True):
                    data = record(*row, date)
                    if archive is None:
                        sample.append(data)
                        held += len(data)
                        if len(sample) >= SAMPLE_RECORDS or held >= SAMPLE_BYTES:
                            archive = Archive(files.attempt_name(folder, part, ".warc.zst"), sample, level)
                            sample = []
                    else:
                        archive.add(data)
                    if archive is not None and archive.bytes >= ARCHIVE_BYTES:
                        close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    made = with_reference(pages, least_bytes).mapInArrow(run, "path string, records bigint, bytes bigint")
    return written(made, "warc-manifest")


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]`` per record."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if keep_payload:
        names.append("payload")
        kinds.append(pa.binary())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)), kinds, strict=False)], names=names
        )

    def run(batches):
        for batch in batches:
            for entry in batch.to_pylist():
                rows, n = [], 0
                held = 0
                with files.open_for_reading(entry["path"]) as file:
                    for data in frames(file, entry["path"]):
                        n += 1
                        try:
                            row = page_of(data)
                        except ValueError as fault:
                            raise ValueError(f"{entry['path']}, record {n}: {fault}") from None
                        if row is None:
                            continue
                        rows.append(row[: len(names)])
                        held += len(data)
                        if len(rows) >= 1024 or held >= 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if n != entry["records"]:
                    raise ValueError(f"{entry['path']}: {n} records, the manifest has {entry['records']}")
                if rows:
                    yield batch_of(rows)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    dealt = manifest.select("path", "records").repartition(max(1, manifest.count()))
    return dealt.mapInArrow(run, schema + (", payload binary" if keep_payload else ""))


def with_payload(records: DataFrame) -> DataFrame:
    """Records with the payload of the response in place of a revisit's own."""
    given = records.filter("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("refers_to"), F.col("payload").alias("_payload"), F.col("payload_digest").alias("_digest")
    )
    given = given.dropDuplicates(["refers_to", "_digest"])
    same = (records["refers_to"] == given["refers_to"]) & (records["payload_digest"] == given["_digest"])
    joined = records.join(given, same, "left").drop(given["refers_to"])
    return joined.withColumn("payload", F.coalesce("payload", "_payload")).drop("_payload", "_digest")
