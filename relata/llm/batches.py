"""Batches of rows that stay where they are, and exchanges of packed keys between them.

A batch is one row: its number, and its documents as compressed Arrow data. Batches are hashed on their number when they are
written, so that answers, which are small, come to them and the texts are never shuffled. In an exchange each batch sends,
for each bucket of a hash that it has keys in, its distinct keys, sorted and packed; a bucket's task merges what the batches
have sent and answers each of them, key by key in the order sent. A key that a third of all rows have is sent once by each
batch. The number of buckets follows the input's size, so that a task's data do not grow; a message holds one key at least,
so there are never more of them than keys, however many buckets there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import bucketed, bytes_of, saved

#: Bytes of text in a batch, about, where not asked for otherwise; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes of text whose keys one bucket of an exchange gets, about.
BUCKET_BYTES = 16 << 20
#: Bytes of stored batches that a task reads, about.
TASK_BYTES = 32 << 20
#: The engine's own limit to a table's buckets; beyond it tasks read more.
MOST_TASKS = 100_000
ANSWERS = "batch long, bucket long, answer binary"


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def expand(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys as their differences, the bytes of one weight together: the upper ones are mostly 0."""
    return squeeze_planes(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand_planes(data, np.uint64), dtype=np.uint64)


def squeeze_planes(array: np.ndarray) -> bytes:
    """64-bit values, the bytes of one weight together."""
    return squeeze(array.view(np.uint8).reshape(-1, 8).T)


def expand_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(expand(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def join(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes() + b"".join(parts)


def split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data[:8], "<i8")[0])
    sizes = np.frombuffer(data[8 : 8 + 8 * n], "<i8").tolist()
    at, out = 8 + 8 * n, []
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


def batched(docs: DataFrame, label: str, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """(batches of docs, which has a column text; number of buckets for exchanges: as the size asks for, 16 at least)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting, size = [], 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
                out.write_table(pa.Table.from_batches(waiting).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "payload"])

        for part in words.chunks(batches, most=batch_bytes // 8):
            if waiting and size + part.nbytes > batch_bytes:
                yield row()
                number, waiting, size = number + 1, [], 0
            waiting.append(part)
            size += part.nbytes
        if waiting:
            yield row()

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, bytes_of(docs) // TASK_BYTES))
    table = bucketed(docs.mapInArrow(words.released(pack), "batch long, payload binary"), label, "batch", tasks)
    return table, max(16, table.count() * batch_bytes // BUCKET_BYTES)


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def scan(texts, lower: bool) -> words.Words:
    """words.scan of a whole batch, a few MB at a time; without the words' limits and bytes."""
    parts = [words.scan(p.column(0), lower) for p in words.chunks(pa.Table.from_arrays([texts], ["t"]).combine_chunks().to_batches(), "t", 2 << 20)]
    none = np.zeros(0, np.int64)
    count = np.concatenate([none, *(p.count for p in parts)])
    return words.Words(none, none, none, np.concatenate([none.astype(np.uint64), *(p.hash for p in parts)]), count, np.cumsum(count) - count)


class Deal(NamedTuple):
    """Keys in rising order, cut where a bucket's range ends: `order` sorts them; runs[bucket] is the slice of its keys."""

    order: np.ndarray
    runs: dict[int, slice]

    def of(self, bucket: int) -> np.ndarray:
        return self.order[self.runs.get(bucket, slice(0, 0))]


def dealt(keys: np.ndarray, buckets: int) -> Deal:
    """Keys that are spread evenly over 64 bits, by ranges; only buckets that get a key are there."""
    order = np.argsort(keys, kind="stable")
    bucket = ((keys[order] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return Deal(order, {int(bucket[a]): slice(a, b) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)])})


def exchange(batches: DataFrame, buckets: int, send: Callable, merge: Callable, label: str, answers: DataFrame | None = None, answer_type: str = ANSWERS, by: tuple[str, ...] = ()) -> DataFrame:
    """Answers, saved. send(payload, the batch's earlier answers) yields (bucket, data); merge(bucket, [(batch, data)],
    sorted by batch) yields rows of answer_type."""

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("batch", kind="stable")
        answers_ = list(merge(key[0], list(zip(rows["batch"].tolist(), rows["data"]))))
        words.release()
        return pd.DataFrame(answers_, columns=[x.split()[0] for x in answer_type.split(", ")])

    out = _messages(batches, send, answers)
    return saved(out.repartition(_tasks(batches, buckets), "bucket").groupBy("bucket").applyInPandas(merged, answer_type), label, by)


def consult(batches: DataFrame, buckets: int, parts: int, send: Callable, tables: DataFrame, answer: Callable, label: str) -> DataFrame:
    """Answers, saved, of stored tables (bucket, and more) to what batches send. answer([(batch, data)], the bucket's rows) yields
    (batch, data). Where batches are many for the tables' buckets, they are dealt to so many parts of each, which all read its rows."""

    def answered(key: tuple, rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out = [(batch, key[0], data) for batch, data in answer(list(zip(rows["batch"].tolist(), rows["data"])), kept)]
        words.release()
        return pd.DataFrame(out, columns=["batch", "bucket", "answer"])

    tasks = _tasks(batches, buckets * parts)
    asked = _messages(batches, send, None).withColumn("part", F.pmod(F.hash("batch"), F.lit(parts))).repartition(tasks, "bucket", "part")
    copies = tables.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "bucket", "part")
    return saved(asked.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInPandas(answered, ANSWERS), label)


def _tasks(batches: DataFrame, groups: int) -> int:
    return max(int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, groups))


def _messages(batches: DataFrame, send: Callable, answers: DataFrame | None) -> DataFrame:
    """batch, bucket, data: what send yields for each batch and its answers."""

    def sent(key: tuple | None, payload: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = [(b, k, data) for b, p in zip(payload["batch"], payload["payload"]) for k, data in send(p, by_bucket(told))]
        words.release()
        return pd.DataFrame(rows, columns=["batch", "bucket", "data"])

    return met(batches, answers, sent, "batch long, bucket long, data binary")


def by_bucket(told: pd.DataFrame) -> dict[int, bytes]:
    return dict(zip(told["bucket"].tolist(), told["answer"]))


def met(batches: DataFrame, answers: DataFrame | None, work: Callable, result) -> DataFrame:
    """work(key, one batch, its answers) for every batch; batches that weren't answered are worked on too."""
    if answers is None:
        def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            none = pd.DataFrame({"batch": [], "bucket": [], "answer": []})
            for f in frames:
                for k in range(len(f)):
                    yield work(None, f.iloc[k : k + 1], none)

        return batches.mapInPandas(alone, result)
    return batches.groupBy("batch").cogroup(answers.select("batch", "bucket", "answer").groupBy("batch")).applyInPandas(work, result)
