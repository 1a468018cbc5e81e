"""WARC records in seekable Zstandard bundles.

``bundles`` writes a record per page into frames of about ``FRAME_BYTES`` that decompress on their
own, and frames into bundles of about ``BUNDLE_BYTES`` that end in a seek table (a skippable frame
with the compressed and plain size of every frame).  A bundle is one row of a table under the shared
folder - its bytes, and ``entries`` that map each record to its frame and its offset there - so that
Spark's own writer commits it: an attempt that dies leaves nothing behind.  The bytes are a valid
.warc.zst file of their own.

``records`` reads whole bundles back by the seek table; ``fetch`` decompresses only the frames of
the records asked for.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that with the smallest identifier
is the response and the others revisit it: they carry its digest and size, not its payload.  The
equi-join that tells them may have hot keys, which adaptive execution splits.

Defined cases: a null payload is empty; a null identifier is written as ``null``, ranks last and
reads back as null; repeated rows make one record each, all responses if the smallest identifier is
theirs; an empty table gives no bundles; other columns are not read.
"""
from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm.scratch import store

FRAME_BYTES, BUNDLE_BYTES, MIN_REVISIT, LEVEL = 256 << 10, 8 << 20, 100, 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
ENTRY = pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
ENTRIES = "array<struct<page_id:bigint,frame:int,offset:bigint,length:bigint>>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    name = "null" if page is None else page
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=';/?:@&=+$,#%[]!~*()')}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(plain: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of the records from ``at``."""
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in plain[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield head, plain[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(bundle: bytes) -> list[tuple[int, int]]:
    """(start, size) of the compressed frames, from the seek table at the end."""
    n, _, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        packed, _ = struct.unpack_from("<II", bundle, len(bundle) - 9 - 8 * (n - i))
        out.append((at, packed))
        at += packed
    return out


class Writer:
    """Collects records into frames and frames into one bundle."""

    def __init__(self) -> None:
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.begin()

    def begin(self) -> None:
        self.parts, self.sizes, self.entries, self.open, self.here, self.total = [], [], [], [], 0, 0

    def add(self, page: int | None, data: bytes) -> None:
        self.entries.append({"page_id": page, "frame": len(self.sizes), "offset": self.here, "length": len(data)})
        self.open.append(data)
        self.here += len(data)
        self.total += len(data)
        if self.here >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.pack.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.here))
            self.open, self.here = [], 0

    def finish(self) -> tuple[bytes, list[dict]]:
        self.close_frame()
        out = b"".join([*self.parts, seek_table(self.sizes)]), self.entries
        self.begin()
        return out


def bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(bundle, data, entries): the archives of every row, not yet written anywhere."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    first = (rows.filter(F.col("size") >= MIN_REVISIT).groupBy("size", "digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1 AND first IS NOT NULL").drop("n"))
    told = rows.join(first, ["size", "digest"], "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, writer = TaskContext.get().partitionId(), 0, Writer()

        def done() -> pa.RecordBatch:
            nonlocal made
            data, entries = writer.finish()
            made += 1
            return pa.record_batch({"bundle": pa.array([f"pages-{part:06d}-{made:06d}.warc.zst"]), "data": pa.array([data], pa.binary()),
                                    "entries": pa.array([entries], pa.list_(ENTRY))})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to")]
            for values in zip(*columns, strict=True):
                page, url, payload, digest, size, refers = (v.as_py() for v in values)
                writer.add(page, record(page, url, payload, digest, size, refers))
                if writer.total >= BUNDLE_BYTES:
                    yield done()
        if writer.entries:
            yield done()

    return told.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(write, f"bundle string, data binary, entries {ENTRIES}")


def _number(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORD_DDL = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _row(head: dict[str, str], payload: bytes) -> tuple:
    if head["WARC-Type"] == "revisit":
        return (_number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", _number(head["WARC-Refers-To"]), None)
    return _number(head["WARC-Record-ID"]), len(payload), hashlib.sha256(payload).hexdigest(), "response", None, payload


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD.types, strict=True)]
    return pa.record_batch(columns, schema=RECORD) if payloads else pa.record_batch(columns[:-1], schema=pa.schema(list(RECORD)[:-1]))


def records(archive: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the bundles, digests and sizes taken from the payloads read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for data in batch.column("data"):
                bundle = data.as_py()
                for start, size in frames(bundle):
                    if rows := [_row(*x) for x in parse(unpack.decompress(bundle[start:start + size]))]:
                        yield _batch(rows, payloads)

    return archive.select("data").mapInArrow(read, RECORD_DDL if payloads else RECORD_DDL.rpartition(",")[0])


def fetch(archive: DataFrame, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of the given identifiers; only frames that hold one are decompressed."""
    wanted = ids.select(F.col(id_col).cast("long").alias("wanted")).distinct()
    at = (archive.select("bundle", F.explode("entries").alias("e")).join(wanted, F.col("e.page_id") == F.col("wanted"), "left_semi")
          .groupBy("bundle").agg(F.collect_list("e").alias("asked")))  # at most the entries of a bundle
    picked = archive.select("bundle", "data").join(at, "bundle").select("data", "asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for data, asked in zip(batch.column("data"), batch.column("asked"), strict=True):
                bundle, places = data.as_py(), asked.as_py()
                for i, (start, size) in enumerate(frames(bundle)):
                    if here := [e for e in places if e["frame"] == i]:
                        plain = unpack.decompress(bundle[start:start + size])
                        yield _batch([_row(*next(parse(plain[:e["offset"] + e["length"]], e["offset"]))) for e in here], True)

    return picked.mapInArrow(read, RECORD_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(store(bundles(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc"))


ORACLE_SQL = """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
