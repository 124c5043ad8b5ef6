"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member for each record into archive files on shared storage and
returns where each record lies. ``build_index`` sorts the captures by reversed-host URL key into
compressed blocks and keeps a sparse directory: the first key, file, offset and length of each block.
``lookup`` finds the captures of one URL by binary search in the directory, one range read of a block,
binary search in the block, and one range read a record. ``find`` does the same for a table of keys:
a key goes to the index files that may hold it, a search in the part of the directory that lies with such a file gives
the blocks, and each block is read once for all keys sought in it. ``read_back`` reads every record,
block by block, without a search.

A task writes files of its own attempt, and only the rows of the attempt that Spark commits name them,
so a lost executor costs a rewrite and never a wrong record. Paths may be in any store that
``pyarrow.fs`` opens; ``file:`` paths must be on a disk that driver and executors share.

Defined cases: a null html is the empty payload; a null url has the empty key; a null page_id is
written as an empty id and is never the response of others unless all equal payloads have none; rows
that repeat the smallest page_id of a payload are all responses.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, map_batches, new_folder, written
from .skew import lookup_join

#: Captures in a block of the index.
BLOCK_LINES = 2000
_MEMBER_LEVEL = 3
_CAPTURES = "page_id long, key string, url string, file string, offset long, length long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def opened(path: str):
    """(file system, path in it) of a URI."""
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/*", "file:///", path))


def url_key(url: str | None) -> str:
    """Reversed-host key: ``https://www.Site.org:80/a?b#c`` is ``org,site,www:80)/a?b``; a url without host is its own key."""
    if not url:
        return ""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", url)
    if not m:
        return url
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value or index field: control characters and spaces are percent-encoded."""
    return quote(value, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%")) if value else ""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers and leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record, read from its bytes only."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    of = lambda name: (m := re.fullmatch(r"<urn:page:(-?\d*)>", fields.get(name, ""))) and m[1] and int(m[1]) or (0 if m and m[1] == "0" else None)
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": of("WARC-Record-ID"), "url": unquote(fields["WARC-Target-URI"]), "record_type": fields["WARC-Type"], "refers_to": of("WARC-Refers-To"),
        "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
    }


def first_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and first_id: the smallest page_id with the same payload, null where no other is meant (payloads under ``min_bytes``)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"), F.length(payload).alias("bytes"))
    firsts = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
    found = lookup_join(rows, firsts.filter("n > 1"), "sha", "n", ["first_id"])
    return found.select("page_id", "url", "html", F.when(F.col("bytes") >= min_bytes, F.col("first_id")).alias("first_id"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write a record for every row; returns the captures (page_id, key, url, file, offset, length), written to shared storage."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    store, path = opened(folder)
    store.create_dir(path, recursive=True)

    def run(batches):
        out = sink = None
        at = 0
        for rows in batches:
            if out is None:
                store, path = opened(folder)
                task = TaskContext.get()
                name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                out, sink = f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)
            places = []
            for page_id, url, html, first in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id"))):
                payload = (html or "").encode("utf-8", "surrogatepass")
                refers = first if first is not None and first != page_id else None
                data = record(page_id, url, payload, digest_of(payload), refers)
                member = zlib.compressobj(_MEMBER_LEVEL, zlib.DEFLATED, 31)
                data = member.compress(data) + member.flush()
                sink.write(data)
                places.append((at, len(data)))
                at += len(data)
            urls = rows.column("url").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), pa.array([url_key(u) for u in urls], pa.string()), rows.column("url"), pa.array([out] * len(places), pa.string())] + [pa.array(x, pa.int64()) for x in (zip(*places) if places else ([], []))],
                names=["page_id", "key", "url", "file", "offset", "length"],
            )
        if sink is not None:
            sink.close()

    bound_batches(pages.sparkSession)
    return written(first_captures(pages, min_bytes).mapInArrow(run, _CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures by key into compressed blocks; returns the directory (first_key, file, offset, length, lines), one row a block.

    The range exchange orders keys over tasks; captures of one key that fill several blocks are spread by page_id.
    """
    folder = folder or new_folder(captures.sparkSession, "index")
    store, path = opened(folder)
    store.create_dir(path, recursive=True)

    def run(batches):
        out = sink = None
        at, lines, first = 0, [], None

        def block():
            nonlocal at
            data = gzip.compress("".join(lines).encode(), 6, mtime=0)
            sink.write(data)
            row = (first, out, at, len(data), len(lines))
            at += len(data)
            lines.clear()
            return row

        def rows_of(found):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["first_key", "file", "offset", "length", "lines"])

        for batch in batches:
            if out is None:
                store, path = opened(folder)
                task = TaskContext.get()
                name = f"index-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.gz"
                out, sink = f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)
            done = []
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))):
                if not lines:
                    first = key
                lines.append(f"{_line(key)} {_line(file)} {offset} {length}\n")
                if len(lines) >= block_lines:
                    done.append(block())
            if done:
                yield rows_of(done)
        if sink is not None:
            if lines:
                yield rows_of([block()])
            sink.close()

    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return written(ordered.mapInArrow(run, "first_key string, file string, offset long, length long, lines long"), "directory")


def read_block(file: str, offset: int, length: int, files: dict | None = None) -> list[tuple[str, str, int, int]]:
    """The captures (key, file, offset, length) of one block, by one range read."""
    text = gzip.decompress(read_range(file, offset, length, files)).decode()
    return [(unquote(k), unquote(f), int(o), int(n)) for k, f, o, n in (x.split(" ") for x in text.splitlines())]


def read_range(file: str, offset: int, length: int, files: dict | None = None) -> bytes:
    """Bytes [offset, offset + length) of a file; ``files`` keeps a few open ones."""
    handle = files.get(file) if files is not None else None
    if handle is None:
        store, path = opened(file)
        handle = store.open_input_file(path)
        if files is not None:
            if len(files) >= 64:
                files.pop(next(iter(files))).close()
            files[file] = handle
    handle.seek(offset)
    data = handle.read(length)
    if files is None:
        handle.close()
    return data


def _holding(firsts: list[str], key: str) -> range:
    """Of ranges that follow each other and begin with ``firsts``, those that may hold ``key``: the last that begins before it, since it may end with it, and all that begin with it."""
    at = bisect.bisect_left(firsts, key)
    return range(max(0, at - 1), bisect.bisect_right(firsts, key, lo=at))


def _of_key(lines: list[tuple[str, str, int, int]], key: str) -> list[tuple[str, int, int]]:
    """Places (file, offset, length) of the captures of ``key`` in a block."""
    lo = bisect.bisect_left(lines, key, key=lambda x: x[0])
    hi = bisect.bisect_right(lines, key, lo=lo, key=lambda x: x[0])
    return [x[1:] for x in lines[lo:hi]]


def lookup(directory: list[tuple[str, str, int, int]], url: str) -> list[dict]:
    """The records of a url. ``directory`` has (first_key, file, offset, length) sorted by key, as ``sorted_directory`` gives it."""
    key = url_key(url)
    blocks = [directory[i][1:4] for i in _holding([d[0] for d in directory], key)]
    return [parse(gzip.decompress(read_range(*place))) for block in blocks for place in _of_key(read_block(*block), key)]


def sorted_directory(directory: DataFrame) -> list[tuple[str, str, int, int]]:
    """The sparse directory on the driver, in order of keys: a row for each ``BLOCK_LINES`` captures. For point lookups."""
    return sorted(tuple(r) for r in directory.select("first_key", "file", "offset", "length").collect())


def _records(wanted: list[tuple[str, int, int]], files: dict, payloads: bool):
    """Columns of the records at some places, read in the order of files, in batches of bounded payloads."""
    found, size = [], 0
    for place in sorted(wanted):
        found.append(parse(gzip.decompress(read_range(*place, files))))
        size += place[2] if payloads else 0
        if size > 8 << 20:
            yield _record_columns(found, payloads)
            found, size = [], 0
    for handle in files.values():
        handle.close()
    yield _record_columns(found, payloads)


def read_back(directory: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record, read from the archives through the index: a task takes blocks, and range-reads their records in the order of files."""

    def batch(rows: pa.RecordBatch):
        for block in zip(*(rows.column(c).to_pylist() for c in ("file", "offset", "length"))):
            files: dict = {}
            yield from _records([x[1:] for x in read_block(*block, files)], files, payloads)

    spread = directory.select("file", "offset", "length")
    return map_batches(spread.repartition(*_spread(directory)), batch, _schema(payloads))


def locate(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """(file, offset, length, key): the blocks that may hold each distinct ``key`` (null: the empty key), by binary search.

    The first keys of the index files, of which there are as many as ``build_index`` had tasks, are on the driver and go to all tasks. Keys are shuffled to the files
    that may hold them, and meet the blocks of the file there, which a task holds one file at a time.
    """
    spark = directory.sparkSession
    heads = sorted(tuple(r) for r in directory.groupBy("file").agg(F.min("first_key").alias("first_key")).select("first_key", "file").collect())
    names, begins = [h[1] for h in heads], [h[0] for h in heads]

    def files_of(rows: pa.RecordBatch):
        pairs = [(names[i], key) for key in rows.column("key").to_pylist() for i in _holding(begins, key)]
        return {"file": pa.array([p[0] for p in pairs], pa.string()), "key": pa.array([p[1] for p in pairs], pa.string())}

    def blocks_of(batches):
        here, firsts, places = None, [], []
        for rows in batches:
            out = []
            for file, key, offset, length in zip(*(rows.column(c).to_pylist() for c in ("file", "key", "offset", "length"))):
                if file != here:
                    here, firsts, places = file, [], []
                if offset is not None:
                    firsts.append(key)
                    places.append((offset, length))
                else:
                    out += [(file, *places[i], key) for i in _holding(firsts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "offset", "length", "key"])

    wanted = map_batches(keys.select(F.coalesce("key", F.lit("")).alias("key")).distinct(), files_of, "file string, key string")
    sought = wanted.select("file", "key", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"))
    both = sought.unionByName(directory.select("file", F.col("first_key").alias("key"), "offset", "length"))
    bound_batches(spark)
    return both.repartition("file").sortWithinPartitions("file", F.col("offset").asc_nulls_last(), "key").mapInArrow(blocks_of, "file string, offset long, length long, key string")


def find(keys: DataFrame, directory: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all captures whose key is among ``keys`` (column ``key``; repeated keys count once, unknown ones find nothing).

    A block is one range read and a binary search for each key sought in it, then one range read a record. A key that
    holds a third of all captures fills many blocks, which are spread over the tasks.
    """

    def run(batches):
        def records(block, sought):
            files: dict = {}
            lines = read_block(*block, files)
            for columns in _records([place for key in sought for place in _of_key(lines, key)], files, payloads):
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        block, sought = None, []
        for rows in batches:
            for *place, key in zip(*(rows.column(c).to_pylist() for c in ("file", "offset", "length", "key"))):
                if place != block:
                    if block is not None:
                        yield from records(block, sought)
                    block, sought = place, []
                sought.append(key)
        if block is not None:
            yield from records(block, sought)

    bound_batches(directory.sparkSession)
    return locate(keys, directory).repartition(*_spread(directory)).sortWithinPartitions("file", "offset", "key").mapInArrow(run, _schema(payloads))


def _schema(payloads: bool) -> str:
    return _RECORDS if payloads else _RECORDS.removesuffix(", payload binary")


def _spread(directory: DataFrame) -> tuple:
    """Partitions for reading blocks: one for each block up to the shuffle's number, so that no task has them all."""
    parts = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (parts, F.xxhash64("file", "offset"))


def _record_columns(found: list[dict], payloads: bool) -> dict:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"payload": pa.binary()} if payloads else {})
    return {k: pa.array([r[k] for r in found], t) for k, t in kinds.items()}
