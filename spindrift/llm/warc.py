"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``; frames make a
bundle of about ``BUNDLE_BYTES``, which is one file. A bundle ends with two skippable frames: an
index that maps each record's id to its frame and its offset in that frame, and the seek table of
the public seekable format (sizes of every frame, then count, descriptor and magic number). A
plain ``zstd -d`` of a bundle gives a plain WARC file; a seekable reader gets one record by
reading the footer, the index and one frame.

Writing: payload digests are SHA-256 in the JVM. The response of each payload of at least
``DEDUP_BYTES`` is the row of smallest page_id (a partial-then-final min by digest, so a payload
that a third of all rows share is one row per task before the shuffle); roles are joined on ids and
digests alone, salted, and meet the payloads by (page, digest). Texts move once. Each task streams its rows
into frames and yields bundles; Spark's own file writer commits them (one row a file), so a lost
executor or a second attempt leaves no half or double bundle, on any file system Spark can write.

The writer is Spark's text sink, which ends each file with a line separator; the separator is set
to the last byte of the seek table's magic number, so each file is exactly the bundle.

Defined results: a null payload is empty; a null url has no target header; rows with equal id
and payload are all responses if that id is the smallest (such rows share one record id, under
which a reader finds the first); a null page_id is never the smallest
(such a row is a response if no row of its payload has an id); an empty table writes no bundle
and reads back no row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import fresh_path, table

DEDUP_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20
LEVEL = 3
#: The first of a payload meets the payload's pages by (digest, one of so many salts).
SALTS = 8

# Fixed values of the Zstandard frame and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

WARC_DATE = "2024-01-01T00:00:00Z"


# ---------------------------------------------------------------------------- records


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def _target(url: str | None) -> str:
    if not url:
        return ""
    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    return f"WARC-Target-URI: {safe}\r\n"


def build_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response record, or, with ``payload`` None, a revisit of page ``refers_to``."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = (
        f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: {record_id(page_id, digest)}\r\n"
        f"WARC-Date: {WARC_DATE}\r\n{_target(url)}WARC-Payload-Digest: sha256:{digest}\r\n"
    )
    if revisit:
        head += f"WARC-Refers-To: {record_id(refers_to, digest)}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode("utf-8") + body + b"\r\n\r\n"


def parse_record(data: memoryview | bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, offset after the record) of the record at ``at``."""
    data = bytes(data) if not isinstance(data, bytes) else data
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(headers["Content-Length"])
    return headers, data[start : start + size], start + size + 4


# ---------------------------------------------------------------------------- bundles


class Bundle:
    """Builds one seekable bundle; memory is its compressed frames plus one open frame."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level)
        self._limit = frame_bytes
        self._open = bytearray()
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._index: list[bytes] = []
        self.raw = 0

    def add(self, rid: str, record: bytes) -> None:
        if self._open and len(self._open) + len(record) > self._limit:
            self._close()
        key = rid.encode()
        self._index.append(struct.pack("<IIIH", len(self._frames), len(self._open), len(record), len(key)) + key)
        self._open += record
        self.raw += len(record)

    def _close(self) -> None:
        frame = self._zstd.compress(bytes(self._open))
        self._frames.append(frame)
        self._sizes.append((len(frame), len(self._open)))
        self._open = bytearray()

    def finish(self) -> bytes:
        if self._open:
            self._close()
        index = self._zstd.compress(b"".join(self._index))
        index = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        sizes = [*self._sizes, (len(index), 0)]
        table_ = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
        return b"".join([*self._frames, index, struct.pack("<II", SKIPPABLE_SEEK, len(table_)), table_])


class BundleReader:
    """Random access to a bundle by record id."""

    def __init__(self, data: bytes):
        import zstandard

        self._data, self._zstd = data, zstandard.ZstdDecompressor()
        count, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        start = len(data) - 9 - 8 * count
        kind, size = struct.unpack("<II", data[start - 8 : start])
        if kind != SKIPPABLE_SEEK or size != 8 * count + 9:
            raise ValueError("the seek table's frame is damaged")
        self._spans, at = [], 0
        for i in range(count):
            packed, raw = struct.unpack_from("<II", data, start + 8 * i)
            self._spans.append((at, packed, raw))
            at += packed
        at, packed, _ = self._spans.pop()
        raw_index = self._zstd.decompress(data[at + 8 : at + packed])
        self.index: list[tuple[str, int, int, int]] = []
        at = 0
        while at < len(raw_index):
            frame, offset, length, n = struct.unpack_from("<IIIH", raw_index, at)
            at += 14
            self.index.append((raw_index[at : at + n].decode(), frame, offset, length))
            at += n
        self.places: dict[str, tuple[int, int, int]] = {}
        for rid, *place in self.index:
            self.places.setdefault(rid, tuple(place))

    def frame(self, i: int) -> bytes:
        at, packed, raw = self._spans[i]
        return self._zstd.decompress(self._data[at : at + packed], max_output_size=raw)

    def record(self, rid: str) -> bytes:
        """One record, by its id: decompresses its frame only. Of equal records the first."""
        frame, offset, length = self.places[rid]
        return self.frame(frame)[offset : offset + length]

    def records(self) -> Iterator[tuple[str, int, int, bytes]]:
        held, data = -1, b""
        for rid, frame, offset, length in self.index:
            if frame != held:
                held, data = frame, self.frame(frame)
            yield rid, frame, offset, data[offset : offset + length]


# ---------------------------------------------------------------------------- Spark side


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to (null: a response)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    # roles are chosen on ids and digests alone; payloads meet them by (page, digest), so the copies
    # of one page go to as many tasks as there are
    named = rows.where(F.col("payload_bytes") >= dedup_bytes).select("page_id", "payload_digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt")).distinct()
    firsts = named.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages")).where("first_id is not null and pages > 1")
    spread = firsts.select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    roles = named.join(spread, ["payload_digest", "salt"]).where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    roles = roles.select(F.col("page_id").alias("revisit_id"), F.col("payload_digest").alias("revisit_digest"), F.col("first_id").alias("refers_to"))
    joined = rows.join(roles, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("payload_digest") == F.col("revisit_digest")), "left")
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to")


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle = Bundle()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bundle.finish()[:-1]], type=pa.binary())], names=["content"])

    for batch in batches:
        for page, url, payload, size, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bundle.add(record_id(page, digest), build_record(page, url, payload if refers is None else None, size, digest, refers))
            if bundle.raw >= BUNDLE_BYTES:
                yield done()
                bundle = Bundle()
    if bundle.raw:
        yield done()


def write_archives(roles: DataFrame, path: str) -> None:
    """Writes the rows of ``with_roles`` as one bundle a file below ``path``."""
    content = roles.mapInArrow(_bundles, "content binary").select(F.col("content").cast("string").alias("value"))
    last = struct.pack("<I", SEEK_MAGIC)[-1:].decode("latin-1")
    content.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", last).option("compression", "none").text(path)


def _unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for rid, frame, offset, record in BundleReader(content).records():
                headers, block, _ = parse_record(record)
                if headers["WARC-Record-ID"] != rid:
                    raise ValueError(f"the index of {path} names {rid} where {headers['WARC-Record-ID']} lies")
                head, _, payload = block.partition(b"\r\n\r\n")
                http = dict(x.split(": ", 1) for x in head.decode("ascii").split("\r\n")[1:])
                size, digest = int(http["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                kind, refers = headers["WARC-Type"], None
                if kind == "revisit":
                    refers = int(headers["WARC-Refers-To"].split(":")[2])
                elif len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{rid} in {path} doesn't hold the payload of its digest")
                page = rid.split(":")[2]
                rows.append((None if page == "null" else int(page), size, digest, kind, refers, headers.get("WARC-Target-URI"), path, frame, offset))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "bundle", "frame", "frame_offset"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all bundles below ``path``; every response is checked against its
    digest, every index entry against the record it points to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(
        _unbundle,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle string, frame long, frame_offset long",
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(with_roles(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
