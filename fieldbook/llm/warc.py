"""WARC archives of pages, compressed record by record with one Zstandard dictionary, and their reader.

Writing: a page is a record whose payload is its html in UTF-8. Payloads are told apart by their SHA-256; of the pages with
equal payloads of at least ``least`` bytes, that with the smallest id becomes a response, the others are revisits that refer
to it and carry only the headers. The dictionary is trained on a bounded number of whole records, those of the smallest
digests, so reruns agree. An archive starts with the dictionary in a skippable frame (magic number 0x184D2A5D); then every
record is a frame of its own, so that it can be read alone. Spark's text writer commits the archives, one file for each, to
any file system it knows; the separator it ends a file with is an empty skippable frame.

Reading: Spark lists and reads the files, a task walks their frames, takes the dictionary from the first, and parses one
record at a time. The digest of each response is computed again and must be the stated one.

Null html is an empty payload, always a response. A null or empty url has no target line; blanks and control characters in
an url are written as %XX. Pages without an id are never referred to unless all copies lack it: then all are responses, as
are repeated rows of the smallest id. Empty tables make archives without records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm.storage import shared_folder, written

#: Shortest payload in bytes that a revisit may stand for.
LEAST_REVISITED = 100
#: Records that the dictionary is trained on, and the longest payload among them in bytes.
SAMPLE_RECORDS, SAMPLE_PAYLOAD = 256, 1 << 15
DICTIONARY_BYTES = 1 << 16
#: Compressed bytes from which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Magic numbers of skippable frames: that with the dictionary, and an empty frame that separates.
DICTIONARY_MAGIC, PADDING_MAGIC = 0x184D2A5D, 0x184D2A50
SEPARATOR = PADDING_MAGIC.to_bytes(4, "little") + bytes(4)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, record_type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{digest if page_id is None else page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; without a payload it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields of one record, and its payload (None for a revisit). A digest that is not the payload's is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not version.startswith("WARC/") or len(rest) != int(fields["Content-Length"]) + 4:
        raise ValueError(f"not a whole WARC record: {head[:200]!r}")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "record_id": fields["WARC-Record-ID"], "record_type": kind, "page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size, "payload_digest": digest, "refers_to": number("Refers-To-Page-ID"), "payload": payload if kind == "response" else None,
    }


def skippable(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends: its blocks state their sizes."""
    head = data[at : at + 18].tobytes()
    checksum = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    last = False
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        at += 3 + (1 if kind == 1 else block >> 3)
    return at + 4 * checksum


def records_in(archive: memoryview) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    opener, at = zstandard.ZstdDecompressor(), 0
    while at < len(archive):
        magic, size = (int.from_bytes(archive[at + k : at + k + 4], "little") for k in (0, 4))
        if magic & ~15 == PADDING_MAGIC:
            if magic == DICTIONARY_MAGIC and size:
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[at + 8 : at + 8 + size].tobytes()))
            at += 8 + size
        else:
            end = frame_end(archive, at)
            yield opener.decompress(archive[at:end])
            at = end


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of the samples; of too few or too like ones their bytes, which serve as one just the same."""
    joined = b"".join(samples)
    if len(samples) < 8 or len(joined) < 8 * 1024:
        return joined[-size:] if len(joined) >= 8 else b""
    try:
        return zstandard.train_dictionary(min(size, len(joined) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return joined[-size:]


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary") if "html" in pages.columns else F.lit(b"")
    columns = [F.col("page_id").cast("bigint").alias("page_id"), F.col("url")] if "url" in pages.columns else [F.col("page_id").cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("url")]
    return pages.select(*columns, payload.alias("payload")).withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha2("payload", 256))


def planned(pages: DataFrame, least: int = LEAST_REVISITED) -> tuple[DataFrame, DataFrame]:
    """The records to write (page_id, url, payload or null for a revisit, size, digest, refers_to), and each digest's first page and size."""
    each = _payloads(pages)
    firsts = each.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = written(firsts, "warc-payloads")
    repeated = firsts.where((F.col("copies") > 1) & (F.col("size") >= least)).select("digest", "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = each.join(repeated, "digest", "left")
    return rows.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", F.when(again, F.col("first")).alias("refers_to")), firsts


def dictionary_of(pages: DataFrame, firsts: DataFrame, date: str, records: int = SAMPLE_RECORDS, longest: int = SAMPLE_PAYLOAD, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the records of the smallest digests, ``records`` of at most ``longest`` bytes of payload."""
    chosen = firsts.where(F.col("size").between(1, longest)).orderBy("digest").limit(records).select(F.col("digest").alias("chosen"), "first")
    rows = _payloads(pages).join(F.broadcast(chosen), (F.col("digest") == F.col("chosen")) & F.col("page_id").eqNullSafe(F.col("first")), "left_semi")
    rows = rows.groupBy("digest").agg(F.min("page_id").alias("page_id"), F.min("url").alias("url"), F.min("payload").alias("payload"), F.min("size").alias("size"))
    samples = [record(r["page_id"], r["url"], bytes(r["payload"]), r["size"], r["digest"], None, date) for r in rows.orderBy("digest").collect()]
    return trained(samples, size)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> None:
    """Write the archives of a table of pages into a new folder, readable as Zstandard files of WARC records."""
    rows, firsts = planned(pages)
    words = dictionary_of(pages, firsts, date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdCompressor(level=level)
        first = skippable(DICTIONARY_MAGIC, words)
        frames, size = [first], len(first)
        for batch in batches:
            for row in zip(*batch.columns):
                frames.append(packer.compress(record(*(x.as_py() for x in row), date)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], names=["content"])
                    frames, size = [first], len(first)
        if len(frames) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], names=["content"])

    archives = rows.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    archives.write.option("lineSep", SEPARATOR.decode("ascii")).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder: record_id, record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        rows, size = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                for data in records_in(memoryview(content.as_buffer())):
                    rows.append(parsed(data))
                    size += len(data)
                    if size >= 4 << 20:
                        yield batch_of()
                        rows, size = [], 0
        if rows:
            yield batch_of()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """The records, revisits with the payload of the response that they refer to."""
    there = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("there"), F.col("payload_digest").alias("same")).agg(F.first("payload").alias("found"))
    joined = records.join(there, (F.col("refers_to") == F.col("there")) & (F.col("payload_digest") == F.col("same")), "left")
    return joined.select(*(c for c in records.columns if c != "payload"), F.coalesce("payload", "found").alias("payload"))


def archived(pages: DataFrame) -> DataFrame:
    """Write the archives into the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}.warc.zst"
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
