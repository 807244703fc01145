"""WARC archives and a two-level capture index.

Writing: a task writes gzip'd WARC records (one member each) to files of its own
in the shared folder, under names no other attempt uses, and returns a row per
record.  Those rows become a table; only attempts that succeeded are in it, so
a lost or repeated task leaves at most files to which nothing points.

Index: captures are range-partitioned and sorted by their reversed-host key; a
task packs its captures into compressed blocks of ``BLOCK_LINES`` lines, one
index file per task with a sparse directory (first key of each block) at its
end.  The top level, one row (first key, last key, file) per index file, is
bounded by the number of partitions.

Look-up: a key is searched by bisection in the top level, then in one file's
directory, then in a block; only that block and the records it names are read,
by ranges.

Defined cases: null html is an empty payload; a null url is the empty url; rows
with a null page_id never are the smallest id; payloads under ``MIN_DEDUP``
bytes are never revisits; repeated rows are records of their own; a payload of
any length is one record; an empty table gives empty archives and an empty
index; columns not named are ignored.  Ids must be numbers.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, make_dirs, number_of_parts, work_dir, written

MIN_DEDUP = 100
BLOCK_LINES = 1000
ROLL_BYTES = 64 << 20
_TAIL = "<QQ8s"  # place and size of the directory, magic
_MAGIC = b"TWINDEX1"


def url_key(url: Column) -> Column:
    """``com,example)/path?query``: host reversed, scheme, port and fragment gone."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#[\s\S]*$", "")
    host = F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(bare, r"^(?:[^/?#@]*@)?[^/?#:]*(?::[0-9]*)?", "")
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.", -1)), ","), F.lit(")"), rest)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has no payload but says the full one's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (small letters), payload, and the full payload's stated size."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        fields[k.lower()] = v
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    return {"fields": fields, "payload": payload, "full_size": size}


def _number(field: str | None):
    inner = field[len("<urn:page:") : -1] if field else ""
    return int(inner) if inner else None


def _gz(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


_CAPTURE = "key string, page_id long, file string, offset long, length long"


def _write(folder: str):
    def run(batches):
        import pyarrow as pa

        store, path = file_system(folder)
        out = name = None
        at = 0
        try:
            for b in batches:
                rows = []
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256).to_pydict()
                    for page, url, key, html, digest, first in zip(*(part[c] for c in ("page_id", "url", "key", "payload", "digest", "refers_to"))):
                        if out is None or at >= ROLL_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{path}/{name}", compression=None)
                        data = _gz(record(page, url, html.encode("utf-8", "surrogatepass"), digest, first))
                        out.write(data)
                        rows.append((key, page, name, at, len(data)))
                        at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                        names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_dedup: int = MIN_DEDUP) -> DataFrame:
    """Writes the archives below ``folder``; ``key, page_id, file, offset, length``
    of each record as a written table.

    A payload goes over the network once, to meet the first page of its digest;
    that table has only digests that occur twice or more, and a digest that a
    third of the pages share is split by adaptive execution.
    """
    make_dirs(folder)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), url_key(F.col(url).cast("string")).alias("key"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    first = (rows.where(F.col("size") >= min_dedup).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("digest").alias("d"), "first"))
    typed = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("size") >= min_dedup), "left").select(
        "page_id", "url", "key", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return written(typed.mapInArrow(_write(folder), _CAPTURE), "captures", f"{folder}/captures")


def _pack(folder: str):
    def run(batches):
        import pyarrow as pa

        store, path = file_system(folder)
        name = f"index-{uuid.uuid4().hex}.bin"
        out, at, lines, directory, last = None, 0, [], [], None

        def flush():
            nonlocal out, at, lines
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress(json.dumps(lines, ensure_ascii=False).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            at += len(data)
            lines = []

        for b in batches:
            d = b.to_pydict()
            for row in zip(d["key"], d["page_id"], d["file"], d["offset"], d["length"]):
                lines.append(row)
                last = row[0]
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            data = zlib.compress(json.dumps(directory, ensure_ascii=False).encode("utf-8", "surrogatepass"), 6)
            out.write(data + struct.pack(_TAIL, at, len(data), _MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([directory[0][0]]), pa.array([last]), pa.array([name])], names=["first_key", "last_key", "file"])

    return run


def build_index(captures: DataFrame, folder: str, parts: int) -> DataFrame:
    """Top level of the index, ``first_key, last_key, file``, as a written table."""
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return written(ordered.mapInArrow(_pack(folder), "first_key string, last_key string, file string"), "index", f"{folder}/index")


class IndexFile:
    """One index file: its directory in memory, blocks read on demand."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        at, length, magic = struct.unpack(_TAIL, self.file.read_at(struct.calcsize(_TAIL), size - struct.calcsize(_TAIL)))
        if magic != _MAGIC:
            raise ValueError(f"not an index file: {path}")
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, at)).decode("utf-8", "surrogatepass"))
        self.keys = [x[0] for x in self.directory]

    def blocks_of(self, key: str) -> list[int]:
        """Numbers of the blocks in which the key may stand."""
        first = max(0, bisect.bisect_left(self.keys, key) - 1)
        return list(range(first, bisect.bisect_right(self.keys, key)))

    def block(self, n: int) -> list[list]:
        _, at, length = self.directory[n]
        return json.loads(zlib.decompress(self.file.read_at(length, at)).decode("utf-8", "surrogatepass"))


def in_block(lines: list[list], key: str) -> list[list]:
    lo = bisect.bisect_left(lines, key, key=lambda x: x[0])
    hi = bisect.bisect_right(lines, key, key=lambda x: x[0])
    return lines[lo:hi]


def _find_blocks(folder: str, top: list[tuple]):
    lasts = [x[1] for x in top]

    def run(batches):
        import pyarrow as pa

        store, path = file_system(folder)
        opened: tuple[str, IndexFile] | None = None
        for b in batches:
            rows = []
            for key in b.column(0).to_pylist():
                n = bisect.bisect_left(lasts, key)
                while n < len(top) and top[n][0] <= key:
                    if opened is None or opened[0] != top[n][2]:
                        opened = (top[n][2], IndexFile(store, f"{path}/{top[n][2]}"))
                    rows += [(key, top[n][2], k) for k in opened[1].blocks_of(key)]
                    n += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["key", "file", "block"])

    return run


def _read_blocks(folder: str):
    def run(batches):
        import pyarrow as pa

        store, path = file_system(folder)
        index, lines, now = None, [], (None, None)
        for b in batches:
            d = b.to_pydict()
            rows = []
            for key, name, block in zip(d["key"], d["file"], d["block"]):
                if name != now[0]:
                    index = IndexFile(store, f"{path}/{name}")
                if (name, block) != now:
                    lines, now = index.block(block), (name, block)
                rows += in_block(lines, key)
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000]), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    names=["key", "page_id", "file", "offset", "length"])

    return run


def look_up(keys: DataFrame, folder: str, top: DataFrame, parts: int) -> DataFrame:
    """All captures of the given keys (one string column), by way of the index.

    The blocks of a key are found first and read by other tasks, so a key with
    very many captures is spread over as many tasks as it has blocks.
    """
    col = keys.columns[0]
    levels = sorted((r.first_key, r.last_key, r.file) for r in top.collect())  # one row a partition of the index
    wanted = keys.select(F.col(col).alias("key")).where("key is not null").distinct()
    wanted = wanted.repartitionByRange(parts, "key").sortWithinPartitions("key")
    found = wanted.mapInArrow(_find_blocks(folder, levels), "key string, file string, block long")
    dealt = found.repartition(parts, "file", "block").sortWithinPartitions("file", "block", "key")
    return dealt.mapInArrow(_read_blocks(folder), _CAPTURE)


_RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _read(folder: str):
    def run(batches):
        import pyarrow as pa

        store, path = file_system(folder)
        name = file = None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                d = b.slice(lo, 256).to_pydict()
                rows = []
                for n, at, length in zip(d["file"], d["offset"], d["length"]):
                    if n != name:
                        name, file = n, store.open_input_file(f"{path}/{n}")
                    r = parse(zlib.decompress(file.read_at(length, at), 31))
                    f = r["fields"]
                    rows.append((
                        _number(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"],
                        f["warc-payload-digest"].removeprefix("sha256:"), r["full_size"], _number(f.get("warc-refers-to")), r["payload"]))
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

    return run


def read_records(captures: DataFrame, folder: str, parts: int) -> DataFrame:
    """The records that captures name, by range reads in file order."""
    ordered = captures.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read(folder), _RECORD)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Query form: archives all pages, then looks every page's key up and reads
    its record back; payload size and digest of responses are taken from the
    payload that was read, and a revisit's from the fields of its record."""
    folder = work_dir(spark, "warc")
    parts = number_of_parts(spark, pages, "html")
    captures = write_archives(pages, folder)
    top = build_index(captures, folder, parts)
    keys = pages.select(url_key(F.col("url").cast("string")).alias("key"))
    back = read_records(look_up(keys, folder, top, parts), folder, parts)
    own = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(own, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")
