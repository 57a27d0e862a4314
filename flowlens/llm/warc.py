"""Web archives: records compressed one by one with a Zstandard dictionary at the file's head."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import Shipped, stored
from flowlens.session import scratch_path

# Fixed values of the formats: magic of the skippable frame that holds a dictionary, revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# The dictionary and its sample: expected records, bytes taken of a record.
DICTIONARY_BYTES = 64 * 1024
SAMPLE_RECORDS = 600
SAMPLE_BYTES = 16 * 1024
FILE_BYTES = 256 * 1024 * 1024
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, firsts: DataFrame, rows: int, records: int = SAMPLE_RECORDS) -> bytes:
    """A dictionary from a sample of the records as they are archived, headers and revisits included.

    ``records`` of ``rows`` rows are expected, drawn by hash; at most ``SAMPLE_BYTES`` of each are
    looked at. Where they are too few to train on, their last ``DICTIONARY_BYTES`` are the dictionary.
    """
    if not rows:
        return b""
    draw = F.pmod(F.xxhash64(F.lit("dictionary"), "payload", F.monotonically_increasing_id()), F.lit(1 << 30))
    sample = pages.filter(draw < F.lit(min(1.0, records / rows) * (1 << 30)))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[name] for name in ("page_id", "url", "payload", "own", "first_id")]
            yield pa.RecordBatch.from_arrays([pa.array([
                page_record(number, address, payload.encode(), own, first)[:SAMPLE_BYTES]
                for number, address, payload, own, first in zip(*(c.to_pylist() for c in columns))
            ], pa.binary())], ["head"])

    found = with_first(sample, firsts).mapInArrow(heads, "head binary").collect()
    # A record of an empty page stands for all if the draw took none.
    samples = sorted(bytes(r["head"]) for r in found) or [page_record(None, None, b"", True, None)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    """A skippable frame that holds the dictionary."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of one WARC record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in headers]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: bool, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit of the page that has it."""
    digest = base32_sha1(payload)
    headers = [("WARC-Record-ID", page_uri(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(
            r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if first:
        headers.append(("Content-Type", "application/http; msgtype=response"))
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", page_uri(refers_to)),
                ("Content-Type", "application/http; msgtype=response")]
    return record("revisit", headers, http)


class ArchiveWriter:
    """One archive file; it appears under its name only when it is complete."""

    def __init__(self, folder: str, dictionary: bytes) -> None:
        self.system, base = pafs.FileSystem.from_uri(folder)
        self.system.create_dir(base, recursive=True)
        self.name = f"pages-{uuid.uuid4().hex}.warc.zst"
        self.path = f"{base}/{self.name}"
        self.out = self.system.open_output_stream(self.path + ".part")
        held = None
        self.size = self.records = 0
        if dictionary:
            held = zstandard.ZstdCompressionDict(dictionary)
            self._put(dictionary_frame(dictionary))
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=held)
        self._put(self.compressor.compress(record(
            "warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                         ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
            b"format: WARC File Format 1.1\r\n")))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.system.move(self.path + ".part", self.path)
        return self.name, self.records, self.size


def with_first(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(page_id, url, payload, own, first_id): whether a page is a response, and whose payload it shares."""
    own = F.col("page_id").eqNullSafe(F.col("first_id")) | F.col("short")
    return rows.join(firsts, ["digest", "size"]).select("page_id", "url", "payload", own.alias("own"), "first_id")


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, page_id: str = "page_id",
    url: str = "url", html: str = "html",
) -> DataFrame:
    """Archive ``pages`` in ``folder``; returns the manifest (file, records, bytes), stored.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the largest id is the
    response, others revisit it; of repeated rows with that id each is a response, and pages with
    a null id revisit a page that has one. A null text is an empty payload. Files that a lost
    task leaves behind are not in the manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload")})
    rows = rows.withColumn("short", F.col("size") < min_bytes)
    firsts = stored(rows.groupBy("digest", "size").agg(
        F.max("page_id").alias("first_id"), F.count("*").alias("n")), "payloads")
    count = firsts.agg(F.sum("n")).first()[0] or 0
    firsts = firsts.drop("n")
    held = Shipped(spark, train_dictionary(rows, firsts, count))
    ready = with_first(rows, firsts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = held.get()
        writer, done = None, []
        for batch in batches:
            columns = [batch[name] for name in ("page_id", "url", "payload", "own", "first_id")]
            for i in range(len(batch)):
                number, address, payload, first, refers_to = (c[i].as_py() for c in columns)
                writer = writer or ArchiveWriter(folder, dictionary)
                writer.add(page_record(number, address, payload.encode(), first, refers_to))
                if writer.size >= FILE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["file", "records", "bytes"])

    return stored(ready.mapInArrow(write, "file string, records bigint, bytes bigint"), "manifest")


def archive_records(source: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, one at a time."""
    dictionary, head = None, source.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        body = source.read(struct.unpack("<I", head[4:])[0])
        if body[:4] == zstandard.FRAME_HEADER:
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary = zstandard.ZstdCompressionDict(body)
    else:
        source.seek(0)
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(
        source, read_across_frames=True), 1 << 20)
    while version := plain.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {version[:40]!r}")
        headers: dict[str, str] = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = plain.read(int(headers["content-length"]))
        if plain.read(4) != b"\r\n\r\n" or len(block) != int(headers["content-length"]):
            raise ValueError("a record is cut short")
        yield headers, block


def _number(uri: str | None) -> int | None:
    digits = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(digits[1]) if digits else None


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The page records of the archives in ``manifest``, read frame by frame.

    (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload). The digest
    and length of a response are computed from its payload and must agree with its headers.
    """
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    columns += ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def rows(file: str) -> Iterator[tuple]:
        system, base = pafs.FileSystem.from_uri(folder)
        with system.open_input_file(f"{base}/{file}") as source:
            for headers, block in archive_records(source):
                kind = headers["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                size, payload = int(headers["x-payload-length"]), None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if base32_sha1(payload) != digest or len(payload) != size:
                        raise ValueError(f"{file}: payload of {headers['warc-record-id']} is damaged")
                yield (_number(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, size,
                       digest, _number(headers.get("warc-refers-to")), payload)[:len(columns)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch["file"].to_pylist():
                held, size = [], 0
                for row in rows(file):
                    held.append(row)
                    size += 200 + (len(row[-1] or b"") if with_payload else 0)
                    if size > 4_000_000:
                        yield chunk(held)
                        held, size = [], 0
                if held:
                    yield chunk(held)

    def chunk(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(zip(*held), kinds)], columns)

    files = max(1, manifest.count())
    schema = ("page_id bigint, url string, record_type string, payload_bytes bigint, "
              "payload_digest string, refers_to bigint" + ", payload binary" * with_payload)
    return manifest.select("file").repartition(files).mapInArrow(read, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = scratch_path(spark, "warc")
    return read_archives(write_archives(pages, folder), folder, with_payload)
