"""WARC archives of pages: dictionary-compressed records, identical payloads as revisits.

Each task writes archives of its own to a shared folder, under names that no other attempt uses,
and returns a manifest row for each. Only archives of the written manifest are read, so what a
failed or repeated attempt has left does not count. An archive is a skippable frame that holds a
Zstandard dictionary, built from the archive's first records (`SAMPLE` bytes of them), and then
one frame per record, so that any record can be read with the dictionary alone.

Cases: a null html is an empty payload. Of rows with equal payloads of at least `LEAST` bytes,
those with the smallest page id are responses and the others revisit it; a null page id counts as
the largest. So rows that repeat the smallest id are all responses. Shorter payloads are all
responses. A null url is left out of the record; line breaks in one are escaped. An empty table
writes nothing and gives no rows. Other columns are not read.
"""

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import LAST_ID, order_id, scratch, written

LEAST = 100
SAMPLE, DICTIONARY = 2 << 20, 64 << 10
# Record bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
# Pages have no time of their own.
DATE = "1970-01-01T00:00:00Z"

_SKIPPABLE = 0x184D2A5D  # fixed value: the frame that holds an archive's dictionary
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 64 << 10
_ROWS = 256
_RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
            "refers_to long, payload binary")


def _file(path: str):
    """(file system, path) of a location in the shared folder."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, revisit: bool) -> bytes:
    """One record. A revisit has the headers of the response, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {_REVISIT}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return fields, block


def build_dictionary(samples: list[bytes], size: int = DICTIONARY):
    """Trained on the samples; where they are too few to train on, their last bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive; the first records wait for the dictionary that they make."""

    def __init__(self, path: str):
        self.path, self.records, self.bytes = path, 0, 0
        self._waiting: list[bytes] = []
        self._out = self._compress = None

    def add(self, data: bytes) -> None:
        self.records += 1
        self.bytes += len(data)
        if self._compress:
            self._out.write(self._compress(data))
            return
        self._waiting.append(data)
        if self.bytes >= SAMPLE:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        dictionary = build_dictionary(self._waiting)
        raw = dictionary.as_bytes()
        files, path = _file(self.path)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        # The file's ending must not make the file system compress once more.
        self._out = files.open_output_stream(path, compression=None)
        self._out.write(struct.pack("<II", _SKIPPABLE, len(raw)) + raw)
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary).compress
        for data in self._waiting:
            self._out.write(self._compress(data))
        self._waiting = []

    def close(self) -> None:
        if not self._compress:
            self._begin()
        self._out.close()


def read_archive(path: str):
    """The records of an archive, one after another."""
    import zstandard

    files, path = _file(path)
    with files.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != _SKIPPABLE:
            raise ValueError(f"{path} does not begin with a dictionary")
        dictionary = zstandard.ZstdCompressionDict(source.read(size))
        decompress = zstandard.ZstdDecompressor(dict_data=dictionary)
        frame, parts, rest = decompress.decompressobj(), [], b""
        while True:
            chunk = rest or source.read(_READ)
            if not chunk:
                break
            parts.append(frame.decompress(chunk))
            rest = b""
            if frame.eof:
                rest = frame.unused_data
                yield b"".join(parts)
                frame, parts = decompress.decompressobj(), []
        if parts:
            raise ValueError(f"{path} ends inside a record")


def with_roles(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """Rows of pages with size, digest and, for a revisit, the page it refers to. Only narrow
    rows are grouped by payload; the payloads themselves are moved once, by page."""
    html = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), order_id(id_column).alias("key"),
        F.col(url_column).cast("string").alias("url"), html.alias("html"))
    payload = F.col("html").cast("binary")
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2(payload, 256)})
    equal = (
        rows.filter(F.col("size") >= LEAST).groupBy("digest", "size").agg(F.min("key").alias("first"), F.max("key").alias("last"))
        .filter("first <> last").drop("last")
    )
    # The narrow side is joined by payload, where one may be very frequent, the wide one by page.
    revisits = (
        rows.select("key", "digest", "size").distinct().join(equal, ["digest", "size"]).filter("key <> first")
        .select("key", "digest", "first")
    )
    return rows.join(revisits, ["key", "digest"], "left").select(
        "page_id", "url", "html", "size", "digest", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url",
                   html_column: str = "html") -> DataFrame:
    """Write the pages and return the manifest: (archive, records, bytes)."""
    folder = folder or scratch(pages.sparkSession, "warc")

    def task(batches):
        archive, done = None, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, html, size, digest, refers_to = (v.as_py() for v in row)
                if archive is None:
                    archive = Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                archive.add(record(page_id, url, html.encode(), size, digest, refers_to, refers_to is not None))
                if archive.bytes >= ARCHIVE_BYTES:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive:
            archive.close()
            done.append(archive)
        if done:
            yield pa.RecordBatch.from_pydict({
                "archive": [a.path for a in done], "records": [a.records for a in done], "bytes": [a.bytes for a in done]})

    rows = with_roles(pages, id_column, url_column, html_column)
    return written(rows.mapInArrow(task, "archive string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives. Payloads are checked against their digests."""
    def rows(path: str):
        for data in read_archive(path):
            fields, block = parse(data)
            head, _, payload = block.partition(b"\r\n\r\n")
            size = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{path}: a payload differs from its digest")
            to = fields.get("X-Refers-To-Page")
            page = fields.get("X-Page-ID")
            yield (page and int(page), fields.get("WARC-Target-URI"), size, digest, kind, to and int(to),
                   payload if payloads and kind == "response" else None)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [f.split()[0] for f in _RECORDS.split(", ")]

    def task(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                waiting = []
                for row in rows(path):
                    waiting.append(row)
                    if len(waiting) >= _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), kinds, strict=True)], names=names)
                        waiting = []
                if waiting:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), kinds, strict=True)], names=names)

    # One archive after another in a task, and as many tasks as the cluster deals partitions.
    found = manifest.select("archive").repartition("archive").mapInArrow(task, _RECORDS)
    return found.withColumn("refers_to", F.when(F.col("refers_to") < LAST_ID, F.col("refers_to")))
