"""WARC archives with a Zstandard dictionary.

A dictionary is trained on a bounded sample of the archived records, headers and all, put in front of each archive
as a skippable frame, and each record is compressed on its own with it, so that any record can be read by its
place. Records with equal payloads (same SHA-1 and length) are written once: the one with the largest id is
the ``response``, the others are ``revisit`` records that name it.

Defined results: a null payload is an empty one, a null url gives ``urn:page:<id>``. Rows with equal id and
payload are each written; those with the largest id of their payload are all responses. A null id counts as
smaller than any other; it revisits if its payload has a response with an id, and is a response if not.

Each record has an id of its own. That of a response follows from its page's id and payload, so that revisits can name it;
revisits, pages without an id and repeated responses take in the place at which they were written, and what
revisits a repeated response names only the page.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, hashed_sample, rows_of, sized, stored, written_files

#: Magic number of the skippable frame that holds a dictionary, and an empty skippable frame of another kind (all ASCII).
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
#: Bounds of the sample that the dictionary is trained on, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 65_536, 65_536
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def train_dictionary(payloads: DataFrame) -> bytes:
    """A dictionary from about SAMPLE_RECORDS records of any size, drawn by a hash of their id and payload; of a payload of
    more than SAMPLE_BYTES a piece of that size, from a place that the hash tells. Empty if they are too few to train on."""
    size, h = F.octet_length("payload"), F.pmod(F.xxhash64("page_id", F.lit(1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    piece = F.substring("payload", (F.floor(h * F.greatest(size - SAMPLE_BYTES, F.lit(0))) + 1).cast("int"), F.lit(SAMPLE_BYTES))
    sample = hashed_sample(payloads.select("page_id", "url", "payload"), SAMPLE_RECORDS, F.col("page_id"), F.col("payload")).select("page_id", "url", piece.alias("payload")).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(record(r.page_id, r.url, bytes(r.payload), None) for r in sample)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _uri(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", text)


def _name(page_id: int | None, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, alone: bool = True, place: str = "") -> bytes:
    """One WARC/1.1 record. The payload's length stays in a revisit's HTTP header. ``alone``: whether the response (itself, or
    the one it refers to) is the only one of its page and payload; ``place``: where it is written, of no other record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = "" if alone and refers_to is None and page_id is not None else place
    http = _HTTP.format(len(payload)).encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest, own)}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {_uri(url) if url else f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response", f"Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
        lines += [f"WARC-Refers-To: {_name(refers_to, digest)}"] if alone else []
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def archives(records: Iterator[bytes], dictionary: bytes, size: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Archives of records, each compressed as a frame of its own behind the dictionary's frame."""
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
    head = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
    held, parts = 0, [head]
    for r in records:
        frame = pack.compress(r)
        parts.append(frame)
        held += len(frame)
        if held >= size:
            yield b"".join(parts)
            held, parts = 0, [head]
    if held:
        yield b"".join(parts)


def _open(data: bytes) -> zstandard.ZstdDecompressor:
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("this archive doesn't begin with a dictionary's frame")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size])) if size else zstandard.ZstdDecompressor()


def read(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    with _open(data).stream_reader(io.BytesIO(data), read_across_frames=True) as raw:
        stream = io.BufferedReader(raw, 1 << 20)
        while line := stream.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"no record begins with {line[:40]!r}")
            headers = {}
            while (line := stream.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[name.lower()] = value
            block = stream.read(int(headers["content-length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut off")
            yield headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length, digest and, for a response, the payload, whose digest is verified."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        return size, digest, None
    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
    return size, digest, payload


def with_revisits(payloads: DataFrame) -> DataFrame:
    """Adds ``refers_to`` and ``alone`` (see ``record``). Payloads are compared by digests, and only the digests of repeated ones are joined; the payloads
    themselves move only if the revisits are too many to be sent to all tasks. A digest that many rows have is reduced to
    its largest id in each task."""
    marks = stored(payloads.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")), "warc-marks")
    groups = marks.groupBy("sha", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").drop("n")
    met = marks.join(groups, ["sha", "size"]).groupBy("page_id", "sha", "last").agg(F.count(F.lit(1)).alias("n"))
    twice = met.where("page_id = last and n > 1").select("sha", F.lit(False).alias("alone"))
    marked = met.join(twice, "sha", "left").where("page_id is null or page_id < last or not alone")
    others = stored(marked.select("page_id", "sha", "last", F.coalesce("alone", F.lit(True)).alias("alone")), "warc-revisits")
    keyed = payloads.withColumn("sha", F.sha1("payload"))
    return (keyed.alias("p").join(sized(others).alias("o"), F.expr("p.page_id <=> o.page_id and p.sha = o.sha"), "left")
            .select("p.page_id", "p.url", "p.payload", F.expr("nullif(o.last, p.page_id)").alias("refers_to"), F.coalesce("o.alone", F.lit(True)).alias("alone")))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Archives all pages; returns the folder of the archives."""
    payloads = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    bounded_batches(pages.sparkSession)
    dictionary = train_dictionary(payloads)

    def run(batches):
        task = TaskContext.get().partitionId()
        records = (record(*r, f"{task}:{k}") for k, r in enumerate(rows_of(batches, "page_id", "url", "payload", "refers_to", "alone")))
        return batches_of(((a,) for a in archives(records, dictionary)), pa.schema([("content", pa.binary())]), 1)

    return written_files(with_revisits(payloads).mapInArrow(run, "content binary"), "warc", EMPTY_FRAME)


_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_index(spark, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of all records in a folder of archives."""

    def index(batches):
        number = lambda x: int(x) if x else None
        for (content,) in rows_of(batches, "content"):
            for headers, block in read(content):
                size, digest, _ = payload_of(headers, block)
                yield number(headers["page-id"]), size, digest, headers["warc-type"], number(headers.get("refers-to-page-id"))

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(lambda b: batches_of(index(b), _PAGE), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
