"""WARC archives of pages with a two-level capture index.

Writing: every task writes its records, one gzip member each, to an archive of its own in the
shared folder and returns where each record lies. The name is new for every attempt, so a
repeated task never touches what another attempt wrote, and the capture table, once written,
names finished archives only.

Index: captures are sorted by reversed-host URL key and page id over range partitions. A
partition's lines go to compressed blocks of ``BLOCK_LINES``; behind them stands the sparse
directory, one entry a block. The list of partitions with their first keys is as long as their
number and is broadcast. A lookup bisects that list, the directory, and one block, and then
reads the record's byte range.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written

BLOCK_LINES = 2000
LEAST_PAYLOAD = 100
LEVEL = 4
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``, lower-case host, without scheme, user, port and fragment."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_extract(url, parts, 2))
    return F.regexp_replace(F.when(host != "", key).otherwise(F.coalesce(url, F.lit(""))), "[\\x00-\\x20]", "_")


def with_record_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, record_type, refers_to`` for ``pages(page_id, url, html)``.

    Of equal payloads of at least 100 bytes the rows with the smallest page_id are responses,
    the others revisit it; shorter ones are responses. A null id is smallest of all only where
    there is no other.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(
        F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = written(rows.where(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("digest").alias("d"), "first"), "first-seen")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"))


def _record(page_id, url, payload, digest, kind, refers_to) -> bytes:
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(),
            b"WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), f"WARC-Profile: {_PROFILE}".encode()]
        payload = b""
    body = http + payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """WARC headers by lower-case name, and the payload behind the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(b": ") for line in head.split(b"\r\n")[1:])}
    return fields, rest[: int(fields[b"content-length"])].partition(b"\r\n\r\n")[2]


def _write_archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            offsets, lengths = [], []
            columns = [batch.column(c) for c in range(1, 7)]
            for i in range(batch.num_rows):
                member = _gzip(_record(*[c[i].as_py() for c in columns]))
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([name] * len(offsets)), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64())], names=["key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()
    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one record a row of ``pages`` and returns the capture table
    ``key, page_id, archive, offset, length``."""
    rows = with_record_types(pages).select(
        url_key(F.col("url")).alias("key"), "page_id", "url", "payload", "digest", "record_type", "refers_to")
    return written(rows.mapInArrow(_write_archive(folder), (
        "key string, page_id long, archive string, offset long, length long")), "captures")


def _place(key: Column, page_id: Column) -> Column:
    """Sort key of a capture; a null id sorts first."""
    number = F.coalesce(F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")).cast(
        "string"), 20, "0"), F.lit("-"))
    return F.concat(key, F.lit(" "), number)


def _write_index(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, out, at = f"{uuid.uuid4().hex}.cdx", None, 0
        directory: list = []
        waiting: list = []

        def flush():
            nonlocal at, waiting
            block = zlib.compress("\n".join(waiting).encode(), LEVEL)
            directory.append([waiting[0].split("\t")[0], at, len(block)])
            out.write(block)
            at, waiting = at + len(block), []

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                waiting.append("\t".join(map(str, row)))
                if len(waiting) >= block_lines:
                    flush()
        if out is not None:
            if waiting:
                flush()
            packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(packed)
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([directory[0][0]]), pa.array([name]), pa.array([at], pa.int64()),
                 pa.array([len(packed)], pa.int64())], names=["first", "file", "offset", "length"])
    return run


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Writes the index and returns its top level, one ``(first, file, offset, length)`` a range
    partition in order."""
    lines = captures.select(_place(F.col("key"), F.col("page_id")).alias("place"), "archive", "offset", "length")
    order = ["place", "archive", "offset"]
    made = written(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _write_index(folder, block_lines), "first string, file string, offset long, length long"), "index")
    return sorted(tuple(r) for r in made.collect())


class _Reader:
    """Lookups in one task; keeps the directory and block it read last and the archives open."""

    def __init__(self, folder: str, top: list[tuple]):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.top = sorted((t[0].encode(), *t[1:]) for t in top)
        self.firsts = [t[0] for t in self.top]
        self.open = lru_cache(16)(lambda name: self.fs.open_input_file(f"{self.base}/{name}"))
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(4)(self._block)

    def _directory(self, part: int) -> tuple[list[bytes], list]:
        _, name, offset, length = self.top[part]
        entries = json.loads(zlib.decompress(self.open(name).read_at(length, offset)))
        return [e[0].encode() for e in entries], entries

    def _block(self, part: int, nth: int) -> tuple[list[bytes], list]:
        _, offset, length = self.directory(part)[1][nth]
        lines = [x.split(b"\t") for x in zlib.decompress(
            self.open(self.top[part][1]).read_at(length, offset)).split(b"\n")]
        return [x[0] for x in lines], lines

    def find(self, place: bytes) -> Iterator[tuple[str, int, int]]:
        """Archive, offset and length of each capture at ``place``."""
        part = max(0, bisect.bisect_left(self.firsts, place) - 1)
        nth = max(0, bisect.bisect_left(self.directory(part)[0], place) - 1) if self.top else 0
        while part < len(self.top) and self.firsts[part] <= place:
            firsts = self.directory(part)[0]
            while nth < len(firsts) and firsts[nth] <= place:
                places, lines = self.block(part, nth)
                for i in range(bisect.bisect_left(places, place), bisect.bisect_right(places, place)):
                    yield lines[i][1].decode(), int(lines[i][2]), int(lines[i][3])
                nth += 1
            part, nth = part + 1, 0

    def record(self, archive: str, offset: int, length: int) -> tuple[dict[bytes, bytes], bytes]:
        return parse_record(zlib.decompress(self.open(archive).read_at(length, offset), 31))


_READ = ("page_id long, url string, record_type string, payload_digest string, declared_digest string, "
         "payload_bytes long, refers_to long")


def _read(shipped, folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder, shipped.value)
        for batch in batches:
            rows = []
            for place in batch.column(0).to_pylist():
                for found in reader.find(place.encode()):
                    fields, payload = reader.record(*found)
                    page = fields[b"warc-record-id"][len(b"<urn:page:"):-1]
                    kind = fields[b"warc-type"].decode()
                    refers = fields.get(b"warc-refers-to")
                    url = fields.get(b"warc-target-uri")
                    row = [None if page == b"None" else int(page), None if url is None else url.decode(), kind,
                           hashlib.sha256(payload).hexdigest() if kind == "response" else None,
                           fields[b"warc-payload-digest"].decode().removeprefix("sha256:"),
                           len(payload) if kind == "response" else None,
                           int(refers[len(b"<urn:page:"):-1]) if refers else None]
                    rows.append(row + [payload] * with_payload)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            names = [c.split()[0] for c in _READ.split(", ")] + ["payload"]
            width = 7 + with_payload
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], kinds[c]) for c in range(width)], names=names[:width])
    return run


def read_captures(wanted: DataFrame, folder: str, top: list[tuple], with_payload: bool = False) -> DataFrame:
    """The records of ``wanted(url, page_id)``, found through the index; a wanted pair is looked
    up once however often it is listed, and gives every record it has."""
    spark: SparkSession = wanted.sparkSession
    shipped = spark.sparkContext.broadcast(top)
    places = wanted.select(_place(url_key(F.col("url")), F.col("page_id").cast("long")).alias("place")).distinct()
    # A fixed number of tasks: sized by their keys alone, a few tasks would read all records.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return places.repartitionByRange(tasks, "place").sortWithinPartitions("place").mapInArrow(
        _read(shipped, folder, with_payload), _READ + ", payload binary" * with_payload)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archives every row of ``pages(page_id, url, html)`` and reads all of it back: ``page_id,
    payload_bytes, payload_digest, record_type, refers_to``.

    Size and digest are those of the full payload that was read: a revisit takes them from the
    response it refers to. Null html is an empty payload, a null url has an empty key. Rows
    that repeat a page_id each have a record. Other columns are ignored; no rows give no rows.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    pages = pages.select("page_id", "url", "html")
    captures = write_archives(pages, folder)
    top = write_index(captures, folder)
    read = written(read_captures(pages.select("url", "page_id"), folder, top), "read")
    full = written(read.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).where(
        F.col("b") >= LEAST_PAYLOAD).distinct(), "responses")
    return read.join(full, (F.col("refers_to") == F.col("p")) & (F.col("declared_digest") == F.col("d")), "left").select(
        "page_id", F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("payload_digest", "d").alias("payload_digest"), "record_type", "refers_to")
