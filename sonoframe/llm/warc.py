"""WARC archives of web pages and a two-level capture index over them.

Writing. Each page becomes one gzip member: a response record with its payload, or a revisit record that refers to
the page with the same payload and the smallest id (payloads of min_revisit bytes or more). Members are
appended to archives of bounded size in the shared folder; every archive is written under a name of its
attempt and then renamed, so a lost or doubled task leaves whole files only.

Index. Captures are sorted by URL key (host reversed and comma-joined, then path), range-partitioned, and written as index
files of compressed blocks of block_lines lines. A file ends with its sparse block directory: each block's first key, place and
length. One row a file, with its first key and where its directory lies, is all that the driver holds (as many as the session has
shuffle partitions, at most). A look-up searches these rows, reads one directory by range and searches it, reads one block by
range and searches it, and reads its records by range: three binary searches.

Reading back is such look-ups: keys are sorted over the tasks, which find the blocks that may hold them; blocks with their keys are
dealt out again, so a key that fills many blocks is many tasks' work.

Nulls: a null html is an empty payload, a null url the empty key; a page with null id is a response without number. Equal
rows are each a record, and rows of the smallest id with a payload are all responses. An empty table
gives empty archives and an empty result. Ids must be integers.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.staging import new_path, partitions, ship, staged


class Store:
    """Files of the shared folder by path: local ones directly, others through Arrow's file systems."""

    def __init__(self, root: str):
        scheme = re.match(r"([a-z0-9+.-]+):", root)
        self.local = scheme is None or scheme[1] == "file"
        if self.local:
            self.root = re.sub(r"^file:(//)?", "", root)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(root)

    def put(self, name: str, data: bytes) -> None:
        """Writes a whole file under a name of this attempt, then renames it."""
        path, part = f"{self.root}/{name}", f"{self.root}/.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(part, "wb") as out:
                out.write(data)
            os.replace(part, path)
        else:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(part) as out:
                out.write(data)
            self.fs.move(part, path)

    def open(self, name: str):
        path = f"{self.root}/{name}"
        return open(path, "rb") if self.local else self.fs.open_input_file(path)


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: com,example,blog)/en/7?x=1"""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{f':{port}' if port not in (None, 80, 443) else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of one gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame, root: str, min_revisit: int = 100, archive_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes records into archives below root; (key, page_id, file, place, length) of each capture."""
    spark = pages.sparkSession
    ship(spark)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    thin = own.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).filter(F.col("size") >= min_revisit).drop("size")
    # payloads that occur again: minima are aggregated in parts and written, so that joins with them split where a digest is common
    firsts = staged(thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-repeated")
    sent = own.withColumn("digest", F.sha2("html", 256)).join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when((F.col("page_id") != F.col("first")) & (F.octet_length("html") >= min_revisit), F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        held, size, lines = [], 0, []

        def close() -> pa.RecordBatch:
            data = b"".join(held)
            name = f"archive-{hashlib.sha256(data).hexdigest()[:32]}.warc.gz"  # of its content: an attempt that is repeated gives the same file
            store.put(name, data)
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in lines]), pa.array([x[1] for x in lines], pa.int64()), pa.array([name] * len(lines)), pa.array([x[2] for x in lines], pa.int64()), pa.array([x[3] for x in lines], pa.int64())], names=["key", "page_id", "file", "place", "length"])
            held.clear()
            lines.clear()
            return out

        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                payload, page, digest, first = html.as_py().encode("utf-8", "surrogatepass"), page_id.as_py(), digest.as_py(), first.as_py()
                kind = "response" if first is None else "revisit"
                member = record(kind, page, url.as_py(), payload, digest, first)
                lines.append((url_key(url.as_py()), page, size, len(member)))
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield close()
                    size = 0
        if held:
            yield close()

    return staged(sent.mapInArrow(write, "key string, page_id long, file string, place long, length long"), "warc-captures")


def write_index(captures: DataFrame, root: str, block_lines: int = 1000) -> DataFrame:
    """Sorts captures by key into index files below root; a row a file (first_key, file, place and length of its directory, n)."""
    spark = captures.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, directory, lines, size, n = [], [], [], 0, 0

        def close() -> int:
            block = gzip.compress("".join(json.dumps(x) + "\n" for x in lines).encode(), mtime=0)
            directory.append((lines[0][0], size, len(block)))
            blocks.append(block)
            lines.clear()
            return len(block)

        for batch in batches:
            for line in zip(*(batch[c].to_pylist() for c in ("key", "page_id", "file", "place", "length")), strict=True):
                lines.append(line)
                n += 1
                if len(lines) == block_lines:
                    size += close()
        if lines:
            size += close()
        if blocks:
            blocks.append(gzip.compress("".join(json.dumps(x) + "\n" for x in directory).encode(), mtime=0))
            data = b"".join(blocks)
            name = f"index-{hashlib.sha256(data).hexdigest()[:32]}.gz"
            Store(root).put(name, data)
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name]), pa.array([size]), pa.array([len(blocks[-1])]), pa.array([n])], names=["first_key", "file", "place", "length", "n"])

    ordered = captures.repartitionByRange(partitions(spark), "key", "page_id", "file", "place").sortWithinPartitions("key", "page_id", "file", "place")
    return staged(ordered.mapInArrow(write, "first_key string, file string, place long, length long, n long"), "warc-directory")


def read_lines(store: Store, file: str, place: int, length: int) -> list[list]:
    """The lines of a block or directory, by range."""
    with store.open(file) as f:
        f.seek(place)
        return [json.loads(x) for x in gzip.decompress(f.read(length)).splitlines()]


class Index:
    """Look-ups through the rows of write_index, sorted by first key. The directory last read is kept."""

    def __init__(self, rows: list[tuple], store: Store):
        self.rows, self.store = rows, store
        self.first = [r[0] for r in rows]
        self.kept: tuple[int, list] = (-1, [])

    def _directory(self, k: int) -> list[list]:
        if self.kept[0] != k:
            self.kept = k, read_lines(self.store, *self.rows[k][1:4])
        return self.kept[1]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, place, length) of each block that may hold the key."""
        k = max(0, bisect.bisect_left(self.first, key) - 1)  # the key may begin in the file before one that begins with it
        while k < len(self.rows) and self.first[k] <= key:
            directory = self._directory(k)
            firsts = [d[0] for d in directory]
            at = max(0, bisect.bisect_left(firsts, key) - 1)
            while at < len(directory) and firsts[at] <= key:
                yield (self.rows[k][1], *directory[at][1:3])
                at += 1
            k += 1


def lines_of(lines: list[list], keys: list[str]) -> list[list]:
    """A block's lines of the given keys."""
    own = [x[0] for x in lines]
    return [x for key in keys for x in lines[bisect.bisect_left(own, key) : bisect.bisect_right(own, key)]]


def look_up(directory: list[tuple], root: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """All records of a URL. directory: the rows of write_index, sorted."""
    key, store, out = url_key(url), Store(root), []
    for block in Index(directory, store).blocks(key):
        for _, _, file, place, length in lines_of(read_lines(store, *block), [key]):
            with store.open(file) as f:
                f.seek(place)
                fields, _, payload = parse(f.read(length))
            out.append((fields, payload))
    return out


_RECORD = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def read_archives(keys: DataFrame, directory: DataFrame, root: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the URL keys (key)."""
    spark = keys.sparkSession
    rows = sorted(tuple(r) for r in directory.collect())  # a row an index file: no more than shuffle partitions
    sent = spark.sparkContext.broadcast(rows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now, held = Index(sent.value, Store(root)), None, []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([now[2]]), pa.array([held], pa.list_(pa.string()))], names=["file", "place", "length", "keys"])

        for batch in batches:
            for key in batch["key"].to_pylist():
                for block in index.blocks(key):
                    if block != now:
                        if held:
                            yield close()
                        now, held = block, []
                    held.append(key)
        if held:
            yield close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_RECORD)], names=[n for n, _ in _RECORD])
        for batch in batches:
            for block in batch.to_pylist():
                rows, size, open_, f = [], 0, None, None
                for _, _, file, place, length in sorted(lines_of(read_lines(store, block["file"], block["place"], block["length"]), block["keys"]), key=lambda x: (x[2], x[3])):
                    if file != open_:
                        if f:
                            f.close()
                        open_, f = file, store.open(file)
                    f.seek(place)
                    rows.append(_checked(f.read(length), f"{file} at {place}"))
                    size += len(rows[-1][-1])
                    if size >= batch_bytes:
                        yield made(rows)
                        rows, size = [], 0
                if f:
                    f.close()
                if rows:
                    yield made(rows)

    n = partitions(spark)
    wanted = keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    blocks = wanted.mapInArrow(find, "file string, place long, length long, keys array<string>")
    return blocks.repartition(n).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _checked(member: bytes, where: str) -> tuple:
    """A record's row; an error if its payload is not what its header says."""
    fields, http, payload = parse(member)
    refers = fields.get("WARC-Refers-To")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if refers is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{where}: the payload is not what was written")
    page = fields["WARC-Record-ID"][10:-1]
    return int(page) if page else None, fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], int(refers[10:-1]) if refers else None, payload


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes archives and index of pages into the shared folder and reads every record back."""
    spark: SparkSession = pages.sparkSession
    root = new_path(spark, "warc")
    captures = write_archives(pages, root, **options)
    return read_archives(captures.select("key"), write_index(captures, root), root)
