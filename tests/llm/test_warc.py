"""Archives: round trip, revisits, dictionary frame, damage, odd rows."""

from __future__ import annotations

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from flowlens.llm import warc
from flowlens.llm.warc import (
    DICTIONARY_MAGIC, ArchiveWriter, archive_pages, archive_records, dictionary_frame, page_record,
    read_archives, write_archives,
)

SCHEMA = "page_id bigint, url string, html string, digest string"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_pages_come_back(spark):
    rows = [(i, f"http://h{i % 7}.org/{i}", f"<html>{'text é ' * (i % 50)}{i % 40}</html>", "x") for i in range(300)]
    rows += [(900, None, None, "x"), (901, "http://a b\n/", "", "x"), (902, "u", "WARC/1.1\r\n\r\n", "x"),
             (903, "u", "y" * 300_000, "x"), (904, "u", "y" * 300_000, "x"), (904, "u", "y" * 300_000, "x"),
             (None, "u", "only null", None), (None, "u", "WARC/1.1\r\n\r\n", None)]
    got = archive_pages(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), with_payload=True).collect()
    first = {}
    for page_id, _, html, _ in rows:
        if page_id is not None:
            first[html or ""] = max(page_id, first.get(html or "", -1))
    expected = []
    for page_id, _, html, _ in rows:
        own = first.get(html or "") == page_id
        expected.append((page_id, len((html or "").encode()), sha1(html), "response" if own else "revisit",
                         None if own else first[html or ""], (html or "").encode() if own else None))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
              None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert {r.url for r in got if r.page_id == 901} == {"http://a%20b%0A/"}


def test_dictionary_stands_in_a_leading_skippable_frame(spark, tmp_path):
    rows = [(i, "u", f"<html><head><title>Page {i}</title></head><body>{'common words here ' * 30}{i * 7919}</body>", "")
            for i in range(800)]
    folder = str(tmp_path / "archives")
    manifest = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), folder).collect()
    assert sum(m.records for m in manifest) == 800
    for m in manifest:
        body = (tmp_path / "archives" / m.file).read_bytes()
        assert len(body) == m.bytes
        magic, size = struct.unpack("<II", body[:8])
        assert magic == DICTIONARY_MAGIC and size > 0
        inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body[8:8 + size]))
        first = inflate.decompressobj()
        assert first.decompress(body[8 + size:]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert first.unused_data[:4] == zstandard.FRAME_HEADER  # one frame per record
        assert list(archive_records(io.BytesIO(body)))[1][0]["warc-type"] == "response"


def test_damage_and_small_payloads(spark, tmp_path):
    rows = [(1, "u", "same", ""), (2, "u", "same", ""), (3, "u", "longer text", ""), (4, "u", "longer text", "")]
    folder = str(tmp_path / "a")
    pages = spark.createDataFrame(rows, SCHEMA)
    got = read_archives(write_archives(pages, folder, min_bytes=5), folder).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [
        (1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    writer = ArchiveWriter(folder, b"")
    writer.add(page_record(7, "u", b"payload", True, None).replace(b"payload\r\n", b"pay1oad\r\n"))
    name = writer.close()[0]
    with pytest.raises(Exception, match="damaged"):
        read_archives(spark.createDataFrame([(name, 1, 1)], "file string, records long, bytes long"), folder).collect()
    with pytest.raises(ValueError, match="cut short|no record"):
        list(archive_records(io.BytesIO(zstandard.compress(page_record(7, "u", b"abc", True, None)[:-6]))))
    assert dictionary_frame(b"abc")[8:] == b"abc"


def test_files_are_rolled_and_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    folder = str(tmp_path / "b")
    rows = [(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 4, "") for i in range(60)]
    manifest = write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder)
    assert manifest.count() > 3
    assert read_archives(manifest, folder).count() == 60
    assert archive_pages(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_dictionary_is_of_whole_records_and_stands_even_in_small_archives(spark, tmp_path):
    for count, folder in ((3, "few"), (900, "many")):
        rows = [(i, f"http://h.org/{i}", f"<html>page {i // 2}</html>", "") for i in range(count)]
        manifest = write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / folder)).collect()
        for m in manifest:
            body = (tmp_path / folder / m.file).read_bytes()
            magic, size = struct.unpack("<II", body[:8])
            dictionary = body[8:8 + size]
            assert magic == DICTIONARY_MAGIC
            assert b"WARC-Payload-Digest" in dictionary and b"HTTP/1.1 200 OK" in dictionary
            assert b"revisit" in dictionary
            assert len(list(archive_records(io.BytesIO(body)))) == m.records + 1
