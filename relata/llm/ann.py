"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import gathered, parts_of, saved

FOUND = "query long, found long, lo long, score double"
CELLS = 4  # of one projection; the outermost are open
#: Width of a cell by the projections' spread: four cells of about equal mass. A bucket's rows are then as many as another's,
#: so that the order of falling success is also that of falling success for each row visited.
CELL_WIDTH = 0.7
#: Pairs of a query and a vector that a task holds at a time.
PAIRS = 1 << 20


class Index:
    """tables hash functions of `width` p-stable projections: cells floor((a . x + b) / w), the outer ones open. Vectors get a
    component that makes their norms equal, so that the largest inner products are the smallest distances."""

    def __init__(self, sample: np.ndarray, norm: float, near: int, tables: int, width: int, recall: float, least: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.norm, self.tables, self.width, self.least = norm, tables, width, least
        self.a = rng.standard_normal((tables, width, sample.shape[1] + 1))
        at = self.project(sample)
        spread = at.std(axis=0) if len(sample) > 1 else np.ones((tables, width))
        self.w = np.maximum(spread, 1e-12) * CELL_WIDTH
        self.b = rng.uniform(-0.2, 0.2, (tables, width)) * self.w
        self.centre = at.mean(axis=0) if len(sample) else np.zeros((tables, width))
        self.counts = np.zeros((tables, CELLS**width), np.int64)
        self.success = np.inf
        self._fit(sample, at - self.centre, near, recall)

    def raised(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        up = np.hstack([x / self.norm, np.zeros((len(x), 1))]) if query else self.raised(x)
        return (up @ self.a.reshape(-1, self.a.shape[2]).T).reshape(len(x), self.tables, self.width)

    def _fit(self, sample: np.ndarray, at: np.ndarray, near: int, recall: float) -> None:
        """From some of the sample and their `near` neighbours in it: how a near vector's projection follows its query's (slope
        and spread), and how far the probing must go, in sums of success, for any table to find a share `recall` of them. They
        are farther than the neighbours among all rows, so both are more careful than need be."""
        n = len(sample)
        self.slope, self.noise = np.zeros((self.tables, self.width)), self.w
        if n < 3:
            return
        queries = sample[: min(n, 400)]
        score = queries @ sample.T
        score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
        best = np.argsort(-score, axis=1)[:, : min(near, n - 1)]
        q, x = self.project(queries, True) - self.centre, at[best]
        self.slope = (q[:, None] * x).sum(axis=(0, 1)) / np.maximum((q * q).sum(axis=0) * best.shape[1], 1e-12)
        self.noise = np.maximum((x - self.slope * q[:, None]).std(axis=(0, 1)), 1e-9)
        if recall < 1:
            bucket, reached = self.buckets(sample), np.full(best.shape, np.inf)
            for t in range(self.tables):
                p = self.chances(queries, t)
                order = np.argsort(-p, axis=1, kind="stable")
                before = np.empty_like(p)
                np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1), axis=1)
                reached = np.minimum(reached, np.take_along_axis(before, bucket[:, t][best], 1))
            self.success = float(np.quantile(reached, recall)) + 1e-9

    def buckets(self, x: np.ndarray) -> np.ndarray:
        cell = np.floor((self.project(x) - self.centre + self.b) / self.w).astype(np.int64) + CELLS // 2
        return np.clip(cell, 0, CELLS - 1) @ (CELLS ** np.arange(self.width))

    def chances(self, queries: np.ndarray, table: int) -> np.ndarray:
        """For each query the probability of each bucket that a near vector is there."""
        edge = (np.arange(1, CELLS) - CELLS // 2) * self.w[table][:, None] - self.b[table][:, None]
        q = self.project(queries, True)[:, table] - self.centre[table]
        z = (edge[None] - (self.slope[table] * q)[:, :, None]) / self.noise[table][None, :, None]
        cells = np.diff(0.5 * (1 + _erf(z / math.sqrt(2))), axis=2, prepend=0.0, append=1.0)
        p = np.ones((len(queries), 1))
        for j in range(self.width):
            p = (cells[:, j, :, None] * p[:, None, :]).reshape(len(queries), -1)
        return p

    def probes(self, queries: np.ndarray, table: int) -> np.ndarray:
        """Which buckets each query visits: those of other cells too, by falling probability, until they sum to `success` and at
        least `least` rows (or all) are met."""
        p = self.chances(queries, table)
        order = np.argsort(-p, axis=1, kind="stable")
        sums, rows = np.cumsum(np.take_along_axis(p, order, 1), axis=1), np.cumsum(self.counts[table][order], axis=1)
        enough = (sums >= self.success) & (rows >= min(self.least, int(self.counts[table].sum())))
        visit = np.zeros(p.shape, bool)
        np.put_along_axis(visit, order, np.hstack([np.ones((len(p), 1), bool), ~enough[:, :-1]]), axis=1)
        return visit & (self.counts[table] > 0)


_erf = np.vectorize(math.erf, otypes=[float])


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors packed as bytes of doubles, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def usable(column):
    """No vector, a zero vector, or one that holds a null or non-finite component takes no part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return column.isNotNull() & F.forall(column, lambda x: F.coalesce(good(x), F.lit(False))) & F.exists(column, lambda x: x != 0)


def _best(q: np.ndarray, x: np.ndarray, bar: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact score) of at least each query's `most` best rows among those that reach its bar. Products of matrices
    come first; rows that rounding may have brought below the bar, or below the last of the best, are summed exactly too."""
    score = q @ x.T
    slack = 1e-12 * np.sqrt((q * q).sum(axis=1)) * math.sqrt(float((x * x).sum(axis=1).max()))
    floor = bar - slack
    if len(x) > most:
        floor = np.maximum(floor, -np.partition(-score, most - 1, axis=1)[:, most - 1] - slack)
    i, j = np.nonzero(score >= floor[:, None])
    exact = np.concatenate([np.zeros(0), *((q[i[k : k + 65536]] * x[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536))])
    reach = exact >= bar[i]
    return i[reach], j[reach], exact[reach]


def _top(i: np.ndarray, score: np.ndarray, lo: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's first `most`, by falling score, ties to the smaller lo."""
    order = np.lexsort((lo, -score, i))
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - first < most]


def search(vectors: DataFrame, is_query, nearest: int = 20, tables: int = 8, width: int = 6, recall: float = 0.92, shard_bytes: int = 32 << 20, block: int = 1 << 16, sample_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest by inner product, in double precision, ties to smaller vec_id.

    vectors: vec_id, embedding. is_query(vec_id): the rows to search for; a row isn't its own candidate. Rows with equal
    vectors (by a hash of 128 bits) are indexed as one, with the nearest + 1 smallest ids, since no other can be among
    anyone's nearest; equal queries are searched once. All vectors are in every table. A table's buckets, of which there are
    4 ** width, are dealt in their order to shards of about `shard_bytes` of vectors; a bucket of more is split. A query is sent,
    with the buckets it probes, to the shards that have them, and is compared with those buckets' rows only. A task holds one
    shard and streams the queries past it; a shard is there once for every `block` queries. Groups are cut by (score, smallest
    id), so ties are kept right all the way. The index is fitted on sample_rows vectors with the smallest hashes: cell widths,
    the estimate that orders the probes, and how far they go, so that `recall` of the sample's own neighbours are found (at 1
    all buckets are probed). At least 4 * nearest rows of a table are met, or all it has.

    Rows with a null vec_id take no part, nor those `usable` leaves out. Shorter vectors count as padded with zeros. Repeated
    rows count once; rows with one id and several vectors are candidates each. An empty table gives none; with fewer
    candidates than `nearest` all are found. Column names besides the two don't matter.
    """
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    kind = rows.agg(F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.hypot(s, x))).alias("norm")).first()
    if not kind["d"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = kind["d"]
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("k", F.xxhash64(F.lit(7), "v"))

    def packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            flat = f.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(f.num_rows, size)
            yield pa.RecordBatch.from_arrays([*(f.column(c) for c in ("h", "k", "lo", "asks")), pa.array([r.tobytes() for r in flat], pa.binary())], ["h", "k", "lo", "asks", "data"])

    groups = rows.groupBy("h", "k").agg(F.min("vec_id").alias("lo"), F.max(is_query(F.col("vec_id"))).alias("asks"), F.first("v").alias("v"))
    groups = gathered(groups.select("h", "k", "lo", "asks", "v"), parts_of(vectors))
    groups = saved(groups.mapInArrow(packed, "h long, k long, lo long, asks boolean, data binary").withColumn("g", F.monotonically_increasing_id()), "vectors")
    total = groups.count()
    sample = groups.orderBy("h", "k").limit(sample_rows).select("data").collect()
    sample = np.frombuffer(b"".join(bytes(r["data"]) for r in sample), dtype="<f8").reshape(-1, size)
    index = Index(sample, kind["norm"], math.ceil(nearest * len(sample) / total), tables, width, recall, 4 * nearest)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            bucket = index.buckets(_matrix(f.column("data")))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(f.num_rows, t, np.int32)), pa.array(bucket[:, t].astype(np.int32)), f.column("g")], ["t", "bucket", "g"])

    placed = saved(groups.select("g", "data").mapInArrow(place, "t int, bucket int, g long"), "buckets")
    for r in placed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        index.counts[r["t"], r["bucket"]] = r["n"]
    shard_rows = max(1, shard_bytes // (8 * size))
    parts = -(-index.counts // shard_rows)  # of each bucket
    # Shards are numbered along the table: small buckets share one, a large bucket has as many of its own as it has parts.
    first, shard = np.zeros_like(parts), 0
    for t in range(tables):
        shard, held = shard + 1, 0
        for b in np.flatnonzero(parts[t]).tolist():
            if held and held + index.counts[t, b] > shard_rows:
                shard, held = shard + 1, 0
            first[t, b] = shard
            held += int(index.counts[t, b])
            shard += int(parts[t, b]) - 1

    def sharded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            t, b, g = (f.column(c).to_numpy(zero_copy_only=False) for c in ("t", "bucket", "g"))
            yield pa.RecordBatch.from_arrays([pa.array(first[t, b] + g % parts[t, b]), f.column("bucket"), f.column("g")], ["shard", "bucket", "g"])

    def asked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for at in range(0, f.num_rows, 256):
                part = f.slice(at, 256)
                q = _matrix(part.column("data"))
                for t in range(tables):
                    i, b = np.nonzero(index.probes(q, t))
                    again = parts[t, b]
                    i, b, s = np.repeat(i, again), np.repeat(b, again), np.repeat(first[t, b], again) + np.arange(int(again.sum())) - np.repeat(np.cumsum(again) - again, again)
                    order = np.lexsort((b, s, i))
                    i, b, s = i[order], b[order], s[order]
                    new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (s[1:] != s[:-1])]) if len(i) else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(i)].astype(np.int32)), pa.array(b.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(s[new]), part.column("g").take(pa.array(i[new])), lists], ["shard", "g", "buckets"])

    questions = groups.where("asks").select("g", "data")
    visits = saved(questions.mapInArrow(asked, "shard long, g long, buckets array<int>"), "visits")
    blocks = visits.groupBy("shard").agg(F.expr(f"(count(1) - 1) div {block} + 1").alias("blocks"))
    there = placed.mapInArrow(sharded, "shard long, bucket int, g long").join(blocks, "shard").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    there = there.join(groups.select("g", "lo", "data"), "g").select("shard", "block", F.lit(0).alias("side"), "g", "lo", "bucket", F.array().cast("array<int>").alias("buckets"), "data")
    ask = visits.join(blocks, "shard").withColumn("block", F.pmod("g", "blocks")).join(questions, "g")
    ask = ask.select("shard", "block", F.lit(1).alias("side"), "g", F.lit(0).cast("long").alias("lo"), F.lit(0).alias("bucket"), "buckets", "data")
    both = there.union(ask).repartition("shard", "block").sortWithinPartitions("shard", "block", "side", "bucket", "lo")

    def visit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None
        for f in frames:
            shard, at, side = (f.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "block", "side"))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(at) != 0) | (np.diff(side) != 0)) + 1).tolist(), f.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if (shard[a], at[a]) != now:
                    now, waiting, held = (shard[a], at[a]), [], None
                run = f.slice(a, b - a)
                if side[a] == 0:
                    waiting.append(run)
                    continue
                if held is None and waiting:
                    whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                    held = tuple(whole.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "g", "lo")) + (_matrix(whole.column("data")),)
                    waiting = []
                for k in range(0, b - a, 2048):
                    yield from _meet(run.slice(k, 2048), held, nearest + 1)

    hits = both.mapInArrow(visit, FOUND)
    hits = hits.groupBy("query", "found").agg(F.min("lo").alias("lo"), F.max("score").alias("score"))
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "lo", "found"))).where(F.col("n") <= nearest + 1).drop("n", "lo")
    # A group found gives its smallest ids; the group's queries all get them, each without itself.
    by_group = groups.select("h", "k", "g")
    members = rows.select("h", "k", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("h", "k").orderBy("vec_id"))).where(F.col("n") <= nearest + 1)
    members = members.join(by_group, ["h", "k"]).select(F.col("g").alias("found"), "vec_id")
    hits = hits.join(members, "found").select("query", "vec_id", "score")
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= nearest + 1).drop("n")
    ids = rows.where(is_query(F.col("vec_id"))).select("h", "k", F.col("vec_id").alias("query_id")).distinct().join(by_group, ["h", "k"]).select(F.col("g").alias("query"), "query_id")
    out = ids.join(hits, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return out.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= nearest)


def _meet(queries: pa.RecordBatch, held, most: int) -> Iterator[pa.RecordBatch]:
    """FOUND rows of some queries in the shard held (buckets, ids, smallest ids and vectors, sorted by bucket)."""
    bucket, g, lo, x = held
    q, lists = _matrix(queries.column("data")), queries.column("buckets")
    asks = lists.flatten().to_numpy()
    who = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(asks, kind="stable")
    asks, who, found, held_now = asks[order], who[order], [], 0
    bar = np.full(len(q), -np.inf)  # what a row must reach to be among a query's best
    cuts = [0, *(np.flatnonzero(np.diff(asks)) + 1).tolist(), len(asks)]

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, score = (np.concatenate(c) for c in zip(*found))
        kept = _top(i, score, lo[j], most)
        return i[kept], j[kept], score[kept]

    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        first, last = np.searchsorted(bucket, asks[a], "left"), np.searchsorted(bucket, asks[a], "right")
        few = max(1, PAIRS // max(1, last - first))
        for at in range(a, b if last > first else a, few):
            mine = who[at : min(b, at + few)]
            i, j, score = _best(q[mine], x[first:last], bar[mine], most)
            found.append((mine[i], j + first, score))
            held_now += len(i)
            if held_now > PAIRS:
                i, j, score = best()
                found, held_now = [(i, j, score)], len(i)
                full = np.bincount(i, minlength=len(q)) >= most
                least = np.full(len(q), np.inf)
                np.minimum.at(least, i, score)
                bar[full] = least[full]
    if found:
        i, j, score = best()
        yield pa.RecordBatch.from_arrays([queries.column("g").take(pa.array(i)), pa.array(g[j]), pa.array(lo[j]), pa.array(score)], ["query", "found", "lo", "score"])


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), lambda i: i % 20 == 0)
