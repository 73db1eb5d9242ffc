"""WARC archives, index first.

Writing returns an index: archive, offset, length, URL and payload digest of each record. Reading takes index rows: the
selected records are sorted by place, neighbouring byte ranges are coalesced, and each run is read at once.

A task writes one archive of its own; the index, committed as a Parquet table, says which archives count: one
that a lost or repeated task leaves behind is named nowhere. Archives lie in any folder that all machines reach by
``pyarrow.fs`` (a shared mount, s3, gs, hdfs); each record is a gzip member of its own, as is usual for ``.warc.gz``.

Records with equal payloads of at least ``min_revisit_bytes`` are one response, that of the smallest page_id, and
revisits of it, without payload. The table of repeated digests is broadcast up to ``MAX_REPEATED`` rows. Beyond, a bitmap of
2^``BITS`` bits says which pages can have one of them: only these are joined with it on the digest, where AQE splits the partition
of a hot digest, and all other payloads are written where they are read.

Reading deals slices of archives, of ``SLICE`` bytes, to tasks by the bytes that are asked for, not by the size of the index.

Defined results: null html is an empty payload; a null url is the empty one and line breaks in it become spaces; rows with equal
page_id and equal payload, if they hold the smallest page_id, are all responses; a null page_id is never the smallest
unless no page of that payload has another; no pages make no archive. Columns other than the three named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway.llm.common import scratch_path, small_batches, table

MAX_REPEATED, BITS = 400_000, 28
#: Ranges with at most this gap are read together, up to this length; zlib level of the members.
GAP, RUN = 64 << 10, 8 << 20
#: Bytes of an archive that one task reads together, and that a task reads in all, about.
SLICE, TASK_BYTES = 8 << 20, 64 << 20
LEVEL = 1
INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(sha1: str) -> str:
    """Of a digest in hexadecimal letters."""
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The bytes of one record; of a revisit, the payload is not stored but its length and digest are."""
    block = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}"] if revisit else []),
        *([f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([] if page_id is None else [f"X-Page: {page_id}"]),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(field["Content-Length"])]
    if len(block) != int(field["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    body = block.partition(b"\r\n\r\n")[2]
    revisit = field["WARC-Type"] == "revisit"
    number = lambda name: int(field[name]) if name in field else None
    return {
        "page_id": number("X-Page"), "url": field["WARC-Target-URI"], "record_type": field["WARC-Type"], "refers_to": number("X-Refers-To-Page"),
        "payload_bytes": number("X-Payload-Length") if revisit else len(body), "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else sha1_base32(body), "payload": None if revisit else body,
    }


def bitmap(repeated: DataFrame) -> Callable[[str], Column]:
    """Whether a digest can be one of ``repeated``; each of their places in 2^BITS bits is one, so the broadcast has a fixed size."""
    place = F.shiftrightunsigned(F.xxhash64("digest"), 64 - BITS)
    words = repeated.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(digest), {64 - BITS}) & 63 as int))")).alias("bits"))
    held = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.toLocalIterator():
        held[r["word"]] = r["bits"]
    shared = repeated.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def has(at: pa.Array) -> pa.Array:
        x = at.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[x >> 6] >> (x & 63)) & 1 == 1)

    return lambda digest: has(F.shiftrightunsigned(F.xxhash64(digest), 64 - BITS))


def write(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of ``pages`` in ``folder`` (one of our own in the shared folder by default); returns the index."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"[\r\n]+", " ")
    own = pages.select(pages[id_col].cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= min_revisit_bytes
    repeated = table(own.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "repeated")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & long_enough

    def typed(rows: DataFrame, by: DataFrame) -> DataFrame:
        return rows.join(by, "digest", "left").select("page_id", "url", "payload", "digest", "first", revisit.alias("revisit"))

    if repeated.count() <= MAX_REPEATED:
        records = typed(own, F.broadcast(repeated))
    else:
        can_be = bitmap(repeated)
        alone = own.where(~can_be("digest")).select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("first"), F.lit(False).alias("revisit"))
        records = typed(own.where(can_be("digest")), repeated).unionByName(alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        out, name, at = None, f"{path}/{uuid.uuid4().hex}.warc.gz", 0
        try:
            for b in batches:
                rows = []
                for x in b.to_pylist():
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(name, compression=None)
                    packer = zlib.compressobj(LEVEL, wbits=31)
                    digest = base32(x["digest"])
                    data = packer.compress(record(x["page_id"], x["url"], x["payload"], digest, x["first"] if x["revisit"] else None, x["revisit"], date)) + packer.flush()
                    out.write(data)
                    rows.append({"archive": name.rpartition("/")[2], "offset": at, "length": len(data), "url": x["url"], "payload_digest": digest, "page_id": x["page_id"], "record_type": "revisit" if x["revisit"] else "response"})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
        finally:
            if out is not None:
                out.close()

    return table(records.mapInArrow(run, INDEX).withColumn("archive", F.concat(F.lit(f"{folder}/"), "archive")), "warc-index")


SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def coalesced(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) as runs (archive, offset, length, the parts within)."""
    runs: list[tuple[str, int, int, list[tuple[int, int]]]] = []
    for archive, offset, length in rows:
        if runs and (last := runs[-1])[0] == archive and offset - (last[1] + last[2]) <= GAP and offset + length - last[1] <= RUN:
            last[3].append((offset - last[1], length))
            runs[-1] = (archive, last[1], max(last[2], offset + length - last[1]), last[3])
        else:
            runs.append((archive, offset, length, [(0, length)]))
    return runs


def read(index: DataFrame) -> DataFrame:
    """The records that rows of an index name: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""
    small_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile | None] = ("", None)
        for b in batches:
            for archive, offset, length, parts in coalesced(list(zip(*(b.column(k).to_pylist() for k in range(3))))):
                if opened[0] != archive:
                    if opened[1] is not None:
                        opened[1].close()
                    store, path = fs.FileSystem.from_uri(archive)
                    opened = archive, store.open_input_file(path)
                data = opened[1].read_at(length, offset)
                yield pa.RecordBatch.from_pylist([parse(zlib.decompress(data[a : a + n], wbits=31)) for a, n in parts], RECORD_SCHEMA)
        if opened[1] is not None:
            opened[1].close()

    places = index.select("archive", "offset", "length", F.floor(F.col("offset") / SLICE).alias("slice"))
    size, slices = places.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("archive", "slice")).first()
    tasks = max(1, math.ceil(size / TASK_BYTES), min(slices, index.sparkSession.sparkContext.defaultParallelism))
    places = places.repartition(tasks, "archive", "slice").sortWithinPartitions("archive", "offset")
    return places.mapInArrow(run, RECORD)
