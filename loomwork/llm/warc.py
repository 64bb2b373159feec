"""WARC archives compressed with Zstandard: writing with a shared dictionary, and reading.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; after it
every record is one frame, a warcinfo record first. Records of equal payloads of at least
MIN_REVISIT bytes are written once, as a response, by the smallest page_id; the others revisit it
and keep only their HTTP header, whose Content-Length tells the payload's size. The reader takes
the dictionary from the archive itself, finds frame ends from the block headers without
decompressing, and checks every record: version line, header syntax, Content-Length against the
block, closing lines, and the payload against its digest and HTTP length; what fails raises.

Tasks write archives of about ARCHIVE_BYTES under names that hold their attempt, and report those
that are complete; only reported archives are read, so a lost or repeated task leaves no trace.

Defined cases: a null html is an empty payload; records with a null page_id are always responses,
under the record id of their own row; rows repeated with the smallest page_id are all responses;
control characters in a url are percent-encoded, a null url becomes the record id; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, bounded_sample, keep_id, materialize, released, scratch_path

#: Fixed values of the formats.
SKIPPABLE_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on at most so many payloads, of which it sees at most so many bytes.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 32 << 10
DATE = "2024-01-01T00:00:00Z"


# --- records -----------------------------------------------------------------------------------
def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def make_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=-._~|^`{}\"<>\\ ") if url else record_id(page_id)[1:-1]
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
        return make_record(headers, http)
    return make_record(headers, http + payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case and the block of one record; raises ValueError if malformed."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {data[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"missing header {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest)} bytes does not match Content-Length {length}")
    return fields, rest[:length]


def read_page(fields: dict[str, str], block: bytes) -> dict:
    """One result row of a response or revisit record, checked."""
    http, found, payload = block.partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")
    if not found or not lines[0].startswith("HTTP/"):
        raise ValueError("block without HTTP header")
    size = next(int(x.partition(":")[2]) for x in lines[1:] if x.lower().startswith("content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    if revisit and (payload or fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields):
        raise ValueError("malformed revisit record")
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not match its length or digest")
    return {"page_id": page_of(fields["warc-record-id"]), "url": unquote(fields["warc-target-uri"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page_of(fields.get("warc-refers-to")), "payload": None if revisit else payload}


# --- archives ----------------------------------------------------------------------------------
def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def skippable_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, from its block headers."""
    at_end = at + zstandard.frame_header_size(data[at : at + 18])
    checksum = bool(data[at + 4] & 4)
    while True:
        head = int.from_bytes(data[at_end : at_end + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3 or at_end + 3 > len(data):
            raise ValueError("corrupt Zstandard block")
        at_end += 3 + (1 if kind == 1 else size)
        if head & 1:
            break
    at_end += 4 * checksum
    if at_end > len(data):
        raise ValueError("truncated Zstandard frame")
    return at_end


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == SKIPPABLE_MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        raw = bytes(data[8:at])
        if at > len(data):
            raise ValueError("truncated dictionary frame")
        if int.from_bytes(raw[:4], "little") == ZSTD_MAGIC:  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = frame_end(data, at)
        yield parse_record(reader.decompress(data[at:end]))
        at = end


class ArchiveWriter:
    """Builds one archive in memory; `full` tells when to start another."""

    def __init__(self, dictionary: bytes, limit: int):
        self.parts, self.size, self.records, self.limit = [skippable_frame(dictionary)], 0, 0, limit
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None)
        self._add(make_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:loomwork:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def _add(self, record: bytes) -> None:
        frame = self.packer.compress(record)
        self.parts.append(frame)
        self.size += len(frame)

    def add(self, record: bytes) -> None:
        self._add(record)
        self.records += 1

    @property
    def full(self) -> bool:
        return self.size >= self.limit


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file: into a shared folder, or through pyarrow into a remote store."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        with open(parts.path + ".part", "wb") as f:
            f.write(data)
        os.replace(parts.path + ".part", parts.path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as f:
        f.write(data)


# --- tables ------------------------------------------------------------------------------------
def decide_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    records = keep_id(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long_ = F.octet_length("payload") >= MIN_REVISIT
    # digests come from a scan of their own, so payloads stay out of this aggregate's shuffle
    first = records.where(long_ & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # short payloads are never revisits; of the long ones only those of repeated digests can meet
    # anything, and a digest that very many pages share is split by the adaptive skew join
    known = records.where(long_).join(first, "digest", "left").select(*records.columns, "first")
    other = records.where(~long_).withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    rows = known.unionByName(other)
    return rows.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives under folder; returns the stored list (file, records)."""
    bounded_batches(pages.sparkSession)
    pool = keep_id(pages, "page_id", "html").where("html is not null").select("page_id", F.substring("html", 1, SAMPLE_BYTES).alias("head"))
    dictionary = dictionary_of([r[0].encode() for r in bounded_sample(pool, ["page_id", "head"], SAMPLE_PAGES, pages.count()).select("head").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, number = TaskContext.get(), None, 0

        def close(out: ArchiveWriter) -> pa.RecordBatch:
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.zst"
            put_file(f"{folder}/{name}", b"".join(out.parts))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.records], pa.int64())], ["file", "records"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out = out or ArchiveWriter(dictionary, archive_bytes)
                out.add(page_record(*row))
                if out.full:
                    yield close(out)
                    out, number = None, number + 1
        if out:
            yield close(out)

    return materialize(decide_revisits(pages).mapInArrow(released(run), "file string, records long"), "archives")


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str, files: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """One row per page record of the archives in folder (only those listed in files, if given)."""
    bounded_batches(spark)
    schema = SCHEMA + (", payload binary" if payloads else "")
    if files is not None and not files.limit(1).count():
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if files is not None:
        found = found.join(files.select("file"), "file", "left_semi")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for fields, block in read_archive(content):
                    if fields["warc-type"] in ("response", "revisit"):
                        rows.append(read_page(fields, block))
                    if len(rows) == 1000:
                        yield _rows(rows, names)
                        rows = []
                yield _rows(rows, names)

    return found.select("content").mapInArrow(released(run), schema)


def _rows(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    # stored at once: later changes of the batch size must not reach the reading of whole archives
    return materialize(read_archives(pages.sparkSession, folder, write_archives(pages, folder)), "pages")
