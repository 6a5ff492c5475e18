"""Ogg columns: checked pages, packets from lacing values, logical streams, times from granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import spread

# Fixed values of the format: page head, flags, and the samples a second that this codec claims.
MAGIC, CONTINUED, FIRST, LAST, RATE = b"OggS", 1, 2, 4, 8000
HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))

FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def checksum(page: bytes) -> int:
    """The format's CRC-32, which takes the highest bit first: zlib's, with the bits of each byte and of the sum mirrored."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(HEAD.pack(MAGIC, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    struct.pack_into("<I", page, 22, checksum(bytes(page)))
    return bytes(page)


def stream_pages(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """One logical stream's pages, each with the granule position it belongs at. packets: (bytes, granule position at the end).
    The first packet has the first page for itself; a packet that a page can't hold goes on in the next one."""
    pages, lacing, body, granule, size, flags, number = [], bytearray(), [], -1, 0, FIRST, 0

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, size, flags, number
        pages.append((granule, _page(flags | (LAST if last else 0), granule, serial, number, bytes(lacing), b"".join(body))))
        lacing, body, granule, size, flags, number = bytearray(), [], -1, 0, 0, number + 1

    for k, (packet, end) in enumerate(packets):
        segments = len(packet) // 255 + 1
        at = done = 0
        while done < segments:
            if len(lacing) == 255:
                close(False)
                flags = CONTINUED if done else 0
            take = min(segments - done, 255 - len(lacing))
            done += take
            last = done == segments
            lacing += b"\xff" * (take - last) + (bytes([len(packet) % 255]) if last else b"")
            stop = len(packet) if last else at + 255 * take
            body.append(packet[at:stop])
            at = stop
        granule = end
        if k == 0:
            close(len(packets) == 1)
    if lacing:
        close(True)
    return pages


def encode(samples: bytes, streams: int = 2, packet: int = 4096) -> bytes:
    """Unsigned 8-bit samples as Ogg. Packets go to the logical streams in turn; pages are multiplexed by granule position."""
    key = zlib.crc32(samples)
    packets = [[(b"relata8" + struct.pack("<BBIQ", s, streams, RATE, len(samples)), 0)] for s in range(streams)]
    for k, at in enumerate(range(0, len(samples), packet)):
        packets[k % streams].append((samples[at : at + packet], min(at + packet, len(samples))))
    pages = [[g, s, page] for s in range(streams) for g, page in stream_pages(packets[s], (key + s) & 0xFFFFFFFF)]
    later = 1 << 62  # a page on which no packet ends goes before the page that ends it
    for k in range(len(pages) - 1, -1, -1):
        if pages[k][0] < 0:
            pages[k][0] = pages[k + 1][0] if k + 1 < len(pages) and pages[k + 1][1] == pages[k][1] else later
    heads = {id(p) for p in pages if p[0] == 0}
    return b"".join(p[2] for p in sorted(pages, key=lambda p: (id(p) not in heads, p[0], p[1])))


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule position, serial, number, lacing values, body) of each page; a wrong checksum raises."""
    at = 0
    while at < len(media):
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if magic != MAGIC or version or checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc or end > len(media):
            raise ValueError(f"damaged page at {at}")
        yield flags, granule, serial, number, lacing, media[at + 27 + n : end]
        at = end


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Each logical stream's packets, with the granule position of the page on which they end (of its last packet) or -1."""
    streams: dict[int, list] = {}
    parts: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    for flags, granule, serial, number, lacing, body in pages(media):
        if number != numbers.get(serial, 0) or bool(flags & CONTINUED) != bool(parts.get(serial)):
            raise ValueError(f"stream {serial}: a page is missing before {number}")
        numbers[serial] = number + 1
        out, at = streams.setdefault(serial, []), 0
        part, ended = parts.pop(serial, []), 0
        run = 0
        for x in lacing:
            run += x
            if x < 255:
                part.append(body[at : at + run])
                out.append([b"".join(part), -1])
                at, run, part, ended = at + run, 0, [], ended + 1
        if run or lacing.endswith(b"\xff"):
            part.append(body[at : at + run])
            parts[serial] = part
        if ended:
            out[-1][1] = granule
    return {k: [tuple(x) for x in v] for k, v in streams.items()}


def decode(media: bytes) -> tuple[bytes, dict[str, float]]:
    """(samples, facts) of what `encode` made. A packet's time is its end position: those that pages give, and between
    them by the packets' lengths, since the streams take packets in turn."""
    streams = {}
    for packets in demultiplex(media).values():
        s, n, rate, size = struct.unpack("<BBIQ", packets[0][0][7:])
        streams[s] = packets[1:]
    longest = max(map(len, streams.values()))
    order = [streams[s][k] for k in range(longest) for s in range(n) if k < len(streams[s])]
    end = 0
    for data, granule in order:
        end += len(data)
        if granule >= 0 and granule != end:
            raise ValueError(f"a packet ends at {end}, not at {granule}")
    samples = b"".join(x for x, _ in order)
    if len(samples) != size:
        raise ValueError("samples are missing")
    return samples, {"streams": n, "packets": len(order), "seconds": end / rate}


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, them with bytes 0 up to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def media_row(text: str | None) -> tuple:
    n, data = payload(text)
    media = encode(data)
    samples, facts = decode(media)
    wave = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero(np.diff(wave >= 128)))
    feature = f"streams={facts['streams']};packets={facts['packets']};seconds={facts['seconds']:.6f};sum={int(wave.sum())};energy={int((wave * wave).sum())};crossings={crossings}"
    return n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_features(docs: DataFrame) -> DataFrame:
    """FEATURES per row of docs (doc_id, text): the text's bytes stored as an Ogg file of 8-bit samples, and read back.

    A null or empty text is 64 bytes 0. Equal texts give equal values (serial numbers come from the samples); repeated rows
    are kept; an empty table gives none. A row is worked on alone, so a task's memory is a few times its longest text. Column
    names besides the two don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(media_row(x.as_py()) for x in batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, FEATURES)


def query(spark, sf_dir: str) -> DataFrame:
    return media_features(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
