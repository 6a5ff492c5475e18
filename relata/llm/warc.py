"""WARC records in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import gathered, parts_of, saved

# Fixed values of the formats: Zstandard's skippable frame that holds a seek table, and the number that ends it.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80

BUNDLES = "bundle_id string, data binary, records array<struct<record_id: string, frame: int, offset: int, length: int>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page_id: int | None, content: int, copy: int) -> str:
    """A record's id: that of its page, a hash of its address and payload, since a page may be there several times, and the
    number of the copy, since a row may. It is the same however rows are dealt to tasks."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{content & (1 << 64) - 1:016x}:{copy}>"


def _number(name: str | None) -> int | None:
    text = name[10:-1].partition(":")[0] if name else "null"
    return None if text == "null" else int(text)


def record(name: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit, which refers to another record, has the HTTP head only."""
    revisit = refers_to is not None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Bundle:
    """Collects records into independent frames; `close` appends the seek table as a skippable frame."""

    def __init__(self, frame_bytes: int, level: int) -> None:
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.table, self.open, self.records, self.size = [], [], bytearray(), [], 0

    def add(self, name: str, data: bytes) -> None:
        self.records.append({"record_id": name, "frame": len(self.frames), "offset": len(self.open), "length": len(data)})
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        raw = bytes(self.open)
        self.frames.append(self.pack.compress(raw))
        self.size += len(self.frames[-1])
        self.table.append(struct.pack("<III", len(self.frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open = bytearray()

    def close(self) -> bytes:
        if self.open:
            self._frame()
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """(place, compressed size, size, checksum) of each frame, from the bundle's last bytes."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & CHECKED else 8
    at, out = 0, []
    for k in range(n):
        entry = data[len(data) - 9 - width * (n - k) :][:width]
        packed, size = struct.unpack("<II", entry[:8])
        out.append((at, packed, size, struct.unpack("<I", entry[8:])[0] if width == 12 else -1))
        at += packed
    return out


def frame(data: bytes, entry: tuple[int, int, int, int]) -> bytes:
    """One frame's bytes, checked; the other frames aren't read."""
    at, packed, size, check = entry
    raw = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size)
    if len(raw) != size or check >= 0 and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError("damaged frame")
    return raw


def write_bundles(pages: DataFrame, min_revisit_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 4 << 20, level: int = 3) -> DataFrame:
    """A bundle per row (BUNDLES) with a WARC record per row of pages (page_id, html; url if there is one).

    Of records with equal payloads of at least min_revisit_bytes, the one with the largest page_id is the response, and the
    others are revisits of it. Groups are found on digests alone: rows are counted by id and content before the shuffle, and each
    page then meets its digest's in a join whose large partitions can be split. A null html is an empty payload. A null page_id
    is smaller than any other; a group of null ids only has no revisits. Rows with the same page_id and payload are all
    responses, each with a record id of its own, and revisits name one of them. Ids are made of what is in a row, so that a
    task that is repeated elsewhere gives the same; equal rows are counted, and written as often. Where the input's size is
    known, a task fills about one bundle at least. A very long html is a frame of its own. An empty table gives no bundle. Column
    names besides page_id, url and html don't matter.
    """
    names = {c.lower() for c in pages.columns}
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), (pages["url"] if "url" in names else F.lit(None)).cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("content", F.xxhash64("url", "digest")).withColumn("copies", F.lit(1).cast("long"))
    keys = saved(rows.groupBy("digest", "page_id", "content").agg(F.count(F.lit(1)).alias("n")), "page-keys")
    kept = keys.groupBy("digest").agg(F.max(F.struct("page_id", "content")).alias("kept"))
    repeated = keys.where("n > 1").select("digest", F.col("page_id").alias("id"), F.col("content").alias("c"))
    if repeated.limit(1).count():
        same = (rows["digest"] == repeated["digest"]) & rows["page_id"].eqNullSafe(repeated["id"]) & (rows["content"] == repeated["c"])
        once = rows.join(repeated, same, "left_semi").groupBy("page_id", "url", "html", "digest", "content").agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.join(repeated, same, "left_anti").unionByName(once)
    rows = rows.join(kept, "digest", "left")
    revisit = (F.octet_length("html") >= min_revisit_bytes) & F.col("kept.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept.page_id"))
    rows = rows.select("page_id", "content", "copies", "url", "html", F.when(revisit, F.col("kept.page_id")).alias("refers_to"), F.when(revisit, F.col("kept.content")).alias("refers_content"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, bundle = TaskContext.get().partitionId(), 0, Bundle(frame_bytes, level)
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:06d}"]), pa.array([bundle.close()], pa.binary()), pa.array([bundle.records], kind)], ["bundle_id", "data", "records"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, content, copies, url, html, refers, refers_content = (batch.column(i)[k].as_py() for i in range(7))
                for copy in range(1, copies + 1):
                    name = _name(page, content, copy)
                    bundle.add(name, record(name, url, html.encode(), None if refers is None else _name(refers, refers_content, 1)))
                    if bundle.size >= bundle_bytes:
                        yield row()
                        made, bundle = made + 1, Bundle(frame_bytes, level)
        if bundle.records:
            yield row()

    return gathered(rows, parts_of(pages, bundle_bytes)).mapInArrow(pack, BUNDLES)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """RECORDS of every record in the bundles, found by frame and offset. A response's digest is computed again from its
    payload; a damaged payload raises."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, records in zip(batch.column("data"), batch.column("records").to_pylist()):
                data, rows = data.as_py(), []
                table, last, raw = seek_table(data), -1, b""
                for x in records:
                    if x["frame"] != last:
                        last, raw = x["frame"], frame(data, table[x["frame"]])
                    fields, http, payload = parse(raw[x["offset"] : x["offset"] + x["length"]])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                    rows.append((_number(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, _number(fields.get("WARC-Refers-To"))))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("data", "records").mapInArrow(unpack, RECORDS)


def find(data: bytes, records: list[dict], page_id: int) -> list[bytes]:
    """The records of one page, each read by decompressing its own frame only."""
    table = seek_table(data)
    return [frame(data, table[x["frame"]])[x["offset"] :][: x["length"]] for x in records if _number(x["record_id"]) == page_id]


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_bundles(saved(write_bundles(pages), "bundles"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
e AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM e
"""
