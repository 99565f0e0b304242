"""WARC: a dictionary-compressed writer, and its reader.

A page becomes one record: ``response`` with its html in UTF-8, or, where another page of the same payload has a larger
page_id, ``revisit`` of that one, without a body. Each record is a Zstandard frame of its own, compressed with a dictionary built
from records of the archive itself; the dictionary stands in a leading skippable frame, so an archive can be read alone.

Records are dealt to archives by a hash of the page, about ``ARCHIVE_BYTES`` of payload each; an archive is written whole
by one task into a table in the shared folder, from which it is read back. Which page of equal payloads is the response is
found by one aggregation over digests, in which a payload however common is one row of each task; only digests that
several pages share are joined back.

A null html is an empty payload. A null url is written as ``urn:page:<id>``. Rows of a null page_id become responses and
take no part in revisits. Rows that repeat a page_id and payload are all responses or all revisits, as the first rule says.
Payloads of fewer than ``least_bytes`` bytes are always responses. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import bounded, block_count, written

ARCHIVE_BYTES, LEAST_BYTES, LEVEL = 8 << 20, 0, 3
#: Of an archive's records, how many bytes teach the dictionary, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
#: Fixed by the format: the skippable frame that holds a dictionary.
SKIPPABLE = 0x184D2A5D
_KEYED = "page_id long, url string, payload binary, payload_digest string"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, said: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no body and says what it refers to and how long the payload was."""
    uri = url if url else f"urn:page:{page_id}"
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(uri.split())}", f"WARC-Payload-Digest: sha1:{said}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread evenly over the archive; too few of them to train on are taken as they are."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[:8192] for r in records[::step]]
    if len(sample) >= 16:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 10)), sample)
        except zstandard.ZstdError:  # all alike: nothing to choose between
            pass
    return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes]) -> bytes:
    """The dictionary's frame, then a frame of each record."""
    words = build_dictionary(records)
    packed = words.as_bytes()
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True, write_checksum=True)
    out = [SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed]
    out += [c.compress(r) for r in records]
    return b"".join(out)


def read_archive(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, by means of its own dictionary."""
    if int.from_bytes(archive[:4], "little") != SKIPPABLE:
        raise ValueError("the leading frame is no dictionary")
    size = int.from_bytes(archive[4:8], "little")
    packed = archive[8 : 8 + size]
    trained = packed[:4] == b"\x37\xa4\x30\xec"
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    rest = memoryview(archive)[8 + size :]
    while len(rest):
        one = d.decompressobj()
        yield one.decompress(rest)
        left = len(one.unused_data)
        rest = rest[len(rest) - left :]


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and body."""
    head, _, body = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    return headers, body[: int(headers["Content-Length"])]


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and payload_digest of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                t = b.slice(a, 1000)
                bodies = [x or b"" for x in t.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(bodies, pa.binary()), pa.array([digest(x) for x in bodies], pa.string())], names=["page_id", "url", "payload", "payload_digest"])

    return bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html")).mapInArrow(run, _KEYED)


def archives(pages: DataFrame, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A written table ``archive int, content binary`` of all pages' records."""
    rows = keyed(pages)
    counts = rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least_bytes)).groupBy("payload_digest").agg(F.max("page_id").alias("latest"), F.min("page_id").alias("first"))
    several = written(counts.where("latest <> first").select(F.col("payload_digest").alias("shared_digest"), "latest"), "warc-shared")
    many = block_count(pages, "html", archive_bytes)
    rows = rows.join(several, (F.col("payload_digest") == F.col("shared_digest")) & (F.octet_length("payload") >= least_bytes), "left")
    refers = F.when(F.col("latest") > F.col("page_id"), F.col("latest"))
    dealt = rows.select("page_id", "url", F.col("payload"), "payload_digest", refers.alias("refers_to"), F.pmod(F.xxhash64("page_id", "payload_digest", "url"), F.lit(many)).cast("int").alias("archive"))

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("payload_digest").to_pylist(), t.column("page_id").combine_chunks().fill_null(2**63 - 1).to_numpy()))
        cols = [t.column(c).take(pa.array(order)).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
        content = write_archive([record(*r) for r in zip(*cols)])
        return pa.table({"archive": pa.array([t.column("archive")[0].as_py()], pa.int32()), "content": pa.array([content], pa.binary())})

    return written(dealt.groupBy("archive").applyInArrow(run, "archive int, content binary"), "warc-archives")


def records(archive_table: DataFrame) -> DataFrame:
    """The records of written archives: ``page_id, url, record_type, payload_digest, payload_bytes, refers_to, body``."""

    def number(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows: list[tuple] = []
                for raw in read_archive(content.as_py()):
                    h, body = parse_record(raw)
                    rows.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), number(h.get("WARC-Refers-To")), body))
                    if h["WARC-Type"] == "response" and digest(body) != h["WARC-Payload-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"record {h['WARC-Record-ID']} doesn't match its digest")
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "body"]
                for a in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + 1000]], t) for k, t in enumerate(types)], names=names)

    return archive_table.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, body binary")


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes all pages' archives and describes what is read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    return records(archives(pages, least_bytes)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


RECORDS_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hex,
             max(page_id) OVER (PARTITION BY body) AS latest FROM p),
b AS (SELECT page_id, payload_bytes, latest, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1) AS n FROM s),
d AS (SELECT page_id, payload_bytes, latest,
             list_reduce(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + (((n[(5 * j) // 4 + 1] * 16 + coalesce(n[(5 * j) // 4 + 2], 0)) >> (3 - (5 * j) % 4)) & 31), 1)), lambda x, y: x || y) AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN latest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN latest > page_id THEN latest END AS refers_to
FROM d
"""
