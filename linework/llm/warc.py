"""Zstandard WARC archives: one frame per record, and the dictionary in a leading skippable frame.

`archives` groups pages into archives of about ARCHIVE_BYTES and returns them as binary rows, to be written with any
of Spark's writers; `records` reads such rows (or files read with Spark's binaryFile source) back. The reader loads
the dictionary from the skippable frame, decodes one frame for each record, and checks version, mandatory headers,
Content-Length, both digests and the closing empty lines; a fault raises ValueError with the archive's name.

Of pages with equal payloads the one with the largest page_id is a response; the others are revisit records of the
identical-payload-digest kind, which refer to it and hold no payload. Payloads are equal if their SHA-1, length and another
64-bit hash are. The pages are numbered and written once; only the roles are joined back to them, by that number: no
payload's copies meet in one task.

Nulls: a null html is the empty payload, a null url is left out of the headers, a null page_id is smaller than any
other and has no number in its record's id. Of rows repeated with the same page_id and payload one is the response, the
others revisit it. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import lookup, raw, written

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, SAMPLES, LEVEL = 1 << 15, 300, 3
#: Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, role: str) -> bytes:
    """One WARC record. The HTTP header inside keeps the full payload's length for revisits too."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if role == "response" else http
    head = {
        "WARC-Type": role,
        "WARC-Record-ID": f"<{NAME}{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "WARC-Block-Digest": "sha1:" + digest(block),
        "WARC-Refers-To": f"<{NAME}{'' if refers_to is None else refers_to}>" if role == "revisit" else None,
        "WARC-Profile": REVISIT if role == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n" + block + END


def archive(records: list[bytes]) -> bytes:
    step = max(1, len(records) // SAMPLES)
    samples = records[::step][:SAMPLES]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too short samples: the first record itself is the dictionary
        trained = zstandard.ZstdCompressionDict(samples[0][:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data = trained.as_bytes()
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(data)), data, *map(packer.compress, records)])


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames after the leading dictionary."""
    if len(data) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME or 8 + size > len(data):
        raise ValueError("no dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at = 8 + size
    while at < len(data):
        one, out = reader.decompressobj(), []
        while not one.eof:
            part = data[at : at + 16384]
            if not part:
                raise ValueError("a frame is cut off")
            try:
                out.append(one.decompress(part))
            except zstandard.ZstdError as e:
                raise ValueError(f"a frame is damaged: {e}") from None
            at += len(part)
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, checked."""
    if not data.startswith(VERSION):
        raise ValueError("not a WARC/1.1 record")
    head, found, rest = data[len(VERSION) :].partition(b"\r\n\r\n")
    if not found:
        raise ValueError("headers aren't closed")
    headers = {}
    for line in head.decode().split("\r\n"):
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        headers[key.strip().lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in headers:
            raise ValueError(f"no {key}")
    size = headers["content-length"]
    if not size.isdigit() or len(rest) != int(size) + len(END) or not rest.endswith(END):
        raise ValueError("the block's length isn't Content-Length")
    block = rest[: int(size)]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + digest(block):
        raise ValueError("the block's digest differs")
    return headers, block


def _number(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(NAME)
    return int(text) if text else None


def content(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """(length of the full payload, payload; None for a revisit)."""
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    if headers["warc-type"] == "revisit":
        if payload or headers.get("warc-profile") != REVISIT or "warc-refers-to" not in headers:
            raise ValueError("not a revisit of an identical payload")
        return size, None
    if size != len(payload) or headers.get("warc-payload-digest") != "sha1:" + digest(payload):
        raise ValueError("the payload's length or digest differs")
    return size, payload


def numbered(pages: DataFrame) -> DataFrame:
    """(rid, page_id, url, html), written once; a null html is empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return written(pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")), "pages", compression="zstd")


def roles(rows: DataFrame, least: int = 0) -> DataFrame:
    """(rid, refers_to, role) of numbered pages; least: smaller payloads are never revisits."""
    size = F.octet_length("html")
    slim = written(rows.select("rid", "page_id", F.struct(F.unhex(F.sha1("html")).alias("sha"), size.alias("bytes"), F.xxhash64("html").alias("check")).alias("same")), "payloads")
    groups = written(slim.groupBy("same").agg(F.max(F.struct("page_id", "rid")).alias("first"), F.count("*").alias("n")), "equal-payloads")
    named = lookup(slim, groups, "same", "n", slim.count())
    again = (F.col("same.bytes") >= least) & (F.col("rid") != F.col("first.rid"))
    return named.select("rid", F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, "revisit").otherwise("response").alias("role"))


def archives(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, content, n): the pages as archives."""
    rows = numbered(pages)
    joined = rows.join(roles(rows, least), "rid").select("page_id", "url", "html", "refers_to", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}.warc.zst"]), pa.array([archive(held)], pa.binary()), pa.array([len(held)], pa.int64())], names=["name", "content", "n"])

        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for row in zip(c["page_id"].to_pylist(), c["url"].to_pylist(), raw(c["html"]), c["refers_to"].to_pylist(), c["role"].to_pylist(), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    return joined.mapInArrow(run, "name string, content binary, n long")


def records(stored: DataFrame) -> DataFrame:
    """All records of archives (name, content): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for one in frames(data):
                        h, block = parse(one)
                        size, payload = content(h, block)
                        rows.append((_number(h["warc-record-id"]), h.get("warc-target-uri"), size, h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _number(h.get("warc-refers-to")), payload))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return stored.select(F.col("name"), F.col("content")).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives in the shared folder and reads their records back."""
    return records(written(archives(pages, least), "archives"))
