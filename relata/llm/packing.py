"""Best-fit packing with exact complements, planned on the counts of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved, spread
from .words import chunks, released

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, most: int = 1024, end: int = 2, ranks_path: str | None = None) -> DataFrame:
    """PIECES of each document: its ids, then id `end`; only those of more than `most` ids are cut, the first piece the shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import Encoder

        encoder = Encoder(ranks_path)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in chunks(batches, most=2 << 20):
            ids, at = encoder.ids(batch.column("text"))
            rows, raw = [], memoryview(ids.tobytes())
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                lo, hi = int(at[k]), int(at[k + 1])
                n = hi - lo + 1
                start, piece = 0, 0
                while start < n:
                    size = n if n <= most else (n % most or most) if not piece else most
                    stop = start + size
                    crc = zlib.crc32(raw[4 * (lo + start) : 4 * min(lo + stop, hi)])
                    rows.append((doc, piece, start, size, zlib.crc32(tail, crc) if stop == n else crc))
                    start, piece = stop, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(released(run), PIECES)


def _pairs(left: np.ndarray, gap: int, largest: int, least: int = 1) -> np.ndarray:
    """The smaller lengths y, at least `least`, of pairs that make up gap, both left (twice, if equal), neither above `largest`."""
    y = np.arange(max(least, gap - largest), gap // 2 + 1)
    x = gap - y
    return y[(left[y] > 0) & (left[x] > 0) & ((x != y) | (left[x] > 1))] if len(y) else y


def _fill(left: np.ndarray, gap: int, largest: int, parts: int) -> tuple[int, ...] | None:
    """Up to `parts` lengths (three at the most), none above `largest`, that make up gap exactly and are left often enough: one,
    else a pair, else a triple. Of the pairs and triples that with the largest smallest length is taken, since the short
    lengths are those that fill the most gaps."""
    if gap <= largest and left[gap]:
        return (gap,)
    if parts >= 2:
        y = _pairs(left, gap, largest)
        if len(y):
            return gap - int(y[-1]), int(y[-1])
    if parts >= 3:
        for z in (np.flatnonzero(left[1 : gap // 3 + 1]) + 1)[::-1].tolist():
            for y in _pairs(left, gap - z, largest, z)[::-1].tolist():
                if all(left[k] >= v for k, v in Counter((gap - z - y, y, z)).items()):
                    return gap - z - y, y, z
    return None


#: Which lengths, as shares of a whole sequence, may have their gap filled by two or three: (from, up to).
SPANS = [(0.0, 1.0), *((x, 1.0) for x in (0.5, 0.625, 0.6875, 0.75, 0.8125, 0.875, 0.9375)), *((0.0, x) for x in (0.9375, 0.875, 0.8125, 0.75, 0.6875, 0.625, 0.5, 0.375)), (1.0, 1.0)]


def plan(histogram: dict[int, int], most: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), for all pieces. histogram: pieces of each length, up to `most`.

    From the largest length down: whatever gap it leaves is filled exactly by one, two or three lengths, as often as all of
    them are left; that makes whole sequences. What has no exact complement goes by best fit, largest first, into the
    sequence with the least room that holds it. Where lengths are plentiful, that leaves the least to best fit, and the fewest
    sequences; where they are scarce, sums of two and three use up the short lengths that best fit lacks then. So the spans of
    lengths in SPANS are tried for them, and of the plans with the fewest sequences the one that leaves the fewest pieces to
    best fit is taken. Work and result depend on the number of lengths, not of pieces.
    """
    return min((_plan(histogram, most, lo * most, hi * most) for lo, hi in SPANS), key=lambda p: (sum(n for _, n in p[0]), p[1]))[0]


def _plan(histogram: dict[int, int], most: int, lo: float, hi: float) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(the plan, the number of pieces left to best fit). Gaps of lengths from lo to hi may be filled by sums."""
    left = np.zeros(most + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out, rest = [], []
    if left[most]:
        out.append(((most,), int(left[most])))
        left[most] = 0
    for length in range(most - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            fill = _fill(left, most - length, length, 3 if lo <= length <= hi else 1)
            left[length] += 1
            if fill is None:
                rest.append((length, int(left[length])))
                left[length] = 0
                break
            need = Counter((length, *fill))
            times = min(int(left[k]) // v for k, v in need.items())
            out.append(((length, *fill), times))
            for k, v in need.items():
                left[k] -= v * times
    by_fit = sum(n for _, n in rest)
    groups: dict[int, list] = {}  # by room: [lengths, number]
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = most - sum(lengths)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([lengths, n])

    for length, n in rest:
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):  # new sequences: as many of this length as one holds
                each = most // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            room = rooms[k]
            lengths, there = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.remove(room)
            take = min(n, there)
            if take < there:
                put(lengths, there - take)
            put((*lengths, length), take)
            n -= take
    return out + [(tuple(x), n) for g in groups.values() for x, n in g], by_fit


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: pieces `rank` to the next run's go to sequences `sequence` on, at `offset`."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns))


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """rows with `rank`, from 0, within each value of key, in an order fixed by the rows' hash. Counts of two levels of hash
    bytes are summed first, so that no task ranks more than the 65,536th part of a key's rows."""
    h = F.xxhash64(*rows.columns)
    rows = rows.withColumn("h", h).withColumn("a", F.expr("h & 255")).withColumn("b", F.expr("(h >> 8) & 255"))
    before = (Window.unboundedPreceding, -1)
    cells = rows.groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    parts = cells.groupBy(key, "a").agg(F.sum("n").alias("n"))
    parts = parts.select(key, "a", F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("a").rowsBetween(*before)), F.lit(0)).alias("before_a"))
    cells = cells.withColumn("in_a", F.coalesce(F.sum("n").over(Window.partitionBy(key, "a").orderBy("b").rowsBetween(*before)), F.lit(0)))
    cells = cells.join(parts, [key, "a"]).select(key, "a", "b", (F.col("before_a") + F.col("in_a")).alias("base"))
    local = F.row_number().over(Window.partitionBy(key, "a", "b").orderBy("h", *[c for c in rows.columns if c not in ("h", "a", "b", key)]))
    return rows.withColumn("local", local).join(cells, [key, "a", "b"]).withColumn("rank", F.col("base") + F.col("local") - 1).drop("h", "a", "b", "local", "base")


def pack(docs: DataFrame, most: int = 1024, end: int = 2, ranks_path: str | None = None) -> DataFrame:
    """Each piece of docs (doc_id, text) with its sequence_id and its offset there.

    Texts are tokenized once; the driver gets the number of pieces of each length, `most` numbers at the most, and gives back
    runs of ranks, whose number doesn't depend on the pieces' either. A null or empty text is id `end` alone. A very long text
    is cut into pieces like any other. Repeated rows, and pieces of equal lengths, are packed as often as they are there, in an
    order fixed by their hash; null ids stay null; an empty table gives none. Column names besides doc_id and text don't matter.
    """
    table = saved(pieces(docs, most, end, ranks_path), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = places(plan(histogram, most))
    keys = (runs["length"] << 44) + runs["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            extra = [pa.array(runs["sequence"][k] + rank - runs["rank"][k]), pa.array(runs["offset"][k])]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *extra], [*names, "sequence_id", "offset"])

    return ranked(table, "length").mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
