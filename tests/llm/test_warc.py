import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from placeweave.llm import warc as W

LONG = "<p>payload é " * 40
ROWS = [(1, "http://a/", LONG), (2, "http://b/", LONG), (2, None, LONG), (None, "http://c/", LONG), (3, "x\r\nWARC-Type: y", "short"), (4, None, "short"),
        (5, "http://d/", None), (6, "http://e/", ""), (7, "http://f/", "x" * 100), (8, "http://g/", "x" * 100), (8, "http://g/", "x" * 100),
        (9, "http://h/", "é" * 50), (10, "http://i/", "é" * 50), (11, "http://j/", "x" * 99), (12, "http://k/", "x" * 99), (13, "ü", "big " * 200_000),
        (14, "http://l/", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (None, "http://m/", "z" * 200), (None, "http://m/", "z" * 200)]


def brute(rows):
    out = []
    order = lambda i: W.LAST_ID if i is None else i
    for page_id, _, html in rows:
        payload = (html or "").encode()
        first = min(order(i) for i, _, h in rows if (h or "").encode() == payload)
        revisit = len(payload) >= 100 and order(page_id) != first
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1 << 28, 2000])
def test_pages_round_trip(tables, monkeypatch, size):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", size)
    df = tables(ROWS, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "key": F.lit(0)})
    manifest = W.write_archives(df)
    rows = W.read_archives(manifest).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows), key=repr) == brute(ROWS)
    by_digest = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in ROWS}
    assert all(bytes(r["payload"]) == by_digest[r["payload_digest"]] for r in rows if r["record_type"] == "response")
    assert all(r["payload"] is None for r in rows if r["record_type"] == "revisit")
    assert {r["url"] for r in rows} == {u and u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in ROWS}
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS)
    assert manifest.count() > 3 or size > 2000


def test_archives_begin_with_a_dictionary_and_have_a_frame_a_record(tables):
    rows = [(i, f"http://a/{i}", f"<html><body><h1>Page {i}</h1>" + LONG * 30) for i in range(400)]
    manifest = W.write_archives(tables(rows, "page_id long, url string, html string").coalesce(1))
    (entry,) = manifest.collect()
    _, path = W._file(entry["archive"])
    with open(path, "rb") as file:  # as it is on disk
        data = file.read()
    assert len(data) < sum(len(h) for _, _, h in rows) / 20
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and 0 < size <= W.DICTIONARY
    dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
    assert dictionary.dict_id() != 0  # trained, not just bytes
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    fields, block = W.parse(first.decompress(data[8 + size:]))
    assert first.eof and fields["WARC-Type"] == "response" and block.startswith(b"HTTP/1.1 200 OK")
    # Ordinary readers skip the dictionary's frame.
    frame = zstandard.ZstdDecompressor().decompressobj()
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[8 + size:])
    assert frame is not None and entry["records"] == 400


def test_damage_is_noticed(tables, tmp_path):
    record = W.record(1, "http://a/", b"body", 4, hashlib.sha256(b"other").hexdigest(), None, False)
    archive = W.Archive(str(tmp_path / "bad.warc.zst"))
    archive.add(record)
    archive.close()
    manifest = tables([(str(tmp_path / "bad.warc.zst"),)], "archive string")
    with pytest.raises(Exception, match="differs from its digest"):
        W.read_archives(manifest).collect()
    with pytest.raises(ValueError, match="cut short"):
        W.parse(record[:-3])
    (tmp_path / "none.warc.zst").write_bytes(struct.pack("<II", 1, 0))
    with pytest.raises(ValueError, match="dictionary"):
        list(W.read_archive(str(tmp_path / "none.warc.zst")))


def test_only_archives_of_the_manifest_count(tables, tmp_path):
    df = tables(ROWS[:4], "page_id long, url string, html string")
    W.write_archives(df, str(tmp_path / "w"))
    manifest = W.write_archives(df, str(tmp_path / "w"))
    assert W.read_archives(manifest).count() == 4


def test_no_pages(tables):
    manifest = W.write_archives(tables(ROWS, "page_id long, url string, html string").limit(0))
    assert manifest.count() == 0 and W.read_archives(manifest).count() == 0
