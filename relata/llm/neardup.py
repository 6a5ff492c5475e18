"""Near-duplicates by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import gathered, parts_of, saved, spread

#: Links that one file of the components' tables has, about.
LINKS_A_FILE = 500_000
SETS = "doc_id long, n long, digest long, digest2 long"


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct k-word shingles of each text, sorted, end to end; number of each text's)."""
    scanned = W.scan(texts, True)
    hashes, at = W.windows(scanned, k, 17)
    text = np.repeat(np.arange(len(texts)), scanned.count)[at]
    few = np.flatnonzero((scanned.count > 0) & (scanned.count < k))
    whole = []
    for t in few.tolist():
        w = scanned.hash[scanned.at[t] : scanned.at[t] + scanned.count[t]]
        whole.append(int(W.mix(np.array([(w * W.weights(len(w), 19 + len(w))).sum()], np.uint64))[0]))
    hashes, text = np.append(hashes, np.array(whole, np.uint64)), np.append(text, few)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(texts)).astype(np.int64)


def _signatures(sets: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set 2 * bands keys. bands * rows permutations, each evaluated once, give a minimum and a maximum; `rows`
    minima of different permutations make one key, and their maxima another."""
    mult, flip = W.weights(bands * rows, 23), W.weights(bands * rows, 29)
    out = np.zeros((2 * bands, len(begin)), np.uint64)
    for j in range(bands * rows):
        value = (sets ^ flip[j]) * mult[j]
        value ^= value >> np.uint64(32)
        for half, best in ((0, np.minimum), (1, np.maximum)):
            key = out[half * bands + j // rows]
            key += best.reduceat(value, begin) * mult[j % rows]
    out += np.arange(1, 2 * bands + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return W.mix(out).view(np.int64)


def signatures(docs: DataFrame, k: int = 4, bands: int = 16, rows: int = 5) -> DataFrame:
    """SETS and `bands` (2 * bands keys; null for an empty set) per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, most=2 << 20):
            sets, n = _sets(batch.column("text"), k)
            full = np.flatnonzero(n > 0)
            begin = (np.cumsum(n) - n)[full]
            sums, keys = np.zeros((2, len(n)), np.int64), [None] * len(n)
            if len(full):
                for s, salt in enumerate((31, 37)):
                    sums[s, full] = W.mix(np.add.reduceat(W.mix(sets + np.uint64(salt)), begin)).view(np.int64)
                for t, row in zip(full.tolist(), np.ascontiguousarray(_signatures(sets, begin, bands, rows).T)):
                    keys[t] = row
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "digest2", "bands"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(W.released(run), f"{SETS}, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(digest, shingles) of the classes in `wanted` (doc_id, digest), computed again from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, most=2 << 20):
            sets, n = _sets(batch.column("text"), k)
            ends = np.cumsum(n)
            full = np.flatnonzero(n > 0)
            digest = np.zeros(len(n), np.int64)
            if len(full):
                digest[full] = W.mix(np.add.reduceat(W.mix(sets + np.uint64(31)), (ends - n)[full])).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(sets.view(np.int64)))
            same = pa.array(digest == batch.column("digest").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(digest), lists], ["digest", "shingles"]).filter(same)

    there = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(wanted, "doc_id")
    return there.mapInArrow(W.released(run), "digest long, shingles array<long>").dropDuplicates(["digest"])


def _sets_of(docs: DataFrame, pairs_or_classes: DataFrame, k: int, label: str) -> DataFrame:
    """The full sets, saved, of classes (doc_id, digest)."""
    return saved(gathered(_full_sets(docs, pairs_or_classes.distinct(), k), parts_of(docs)), f"{label}-sets")


def _linked(sets: DataFrame, pairs: DataFrame, percent: int, label: str, parts: int | None) -> DataFrame:
    """Those pairs (a, b: digests; doc_a, doc_b; n_a, n_b) whose full sets are alike enough, as (u, v) of documents, saved."""
    both = pairs.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = both.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common))
    links = both.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct()
    return saved(gathered(links, parts), f"{label}-links")


def _close(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y: rep, digest, n) of classes (rep, digest, n, part) in different parts that can be alike enough.

    With the shingles of all sets in one order, the rarest first, two sets alike enough have one in common among the first
    n - ceil(2 t n / (1 + t)) + 1 of the smaller set and the first n - ceil(t n) + 1 of the larger one, and after the first
    one in common, enough are left in both. So many documents around one frequent passage don't meet each other, unless
    they are nearly all passage.
    """
    each = sets.join(classes.select("digest"), "digest", "left_semi").select("digest", F.explode("shingles").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    by_set = Window.partitionBy("digest")  # a shingle of one set only takes a place, but is met by none
    each = each.join(often, "x").withColumn("from_end", F.count(F.lit(1)).over(by_set) - F.row_number().over(by_set.orderBy("often", "x")) + 1)
    each = each.select("digest", "x", "from_end").join(classes, "digest").withColumn("place", F.col("n") - F.col("from_end") + 1)
    each = each.where(f"place <= n - ({percent} * n + 99) div 100 + 1")
    small = each.where(f"place <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    side = lambda d, s: d.select("x", F.col("part").alias(f"part_{s}"), F.struct("rep", "digest", "n").alias(s), (F.col("n") - F.col("place")).alias(f"rest_{s}"))
    met = side(small, "a").join(side(each, "b"), "x")
    return met.where(f"part_a <> part_b AND (a.n < b.n OR a.n = b.n AND a.digest < b.digest) AND 100 * a.n >= {percent} * b.n AND (1 + least(rest_a, rest_b)) * {100 + percent} >= {percent} * (a.n + b.n)").select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component: the smallest node that can be reached) of every node of links (u > v).

    Alternating steps: each node tells its larger neighbours of its smallest one, then its smaller ones; both only add links
    that lead to smaller nodes, until every node has one link, to its component's smallest. Minima are partial sums before the
    shuffle, and tables of their own, as every step's links are: so each join is one of two shuffled tables, whose large
    partitions, those of a component's smallest node, can be split.
    """
    now = saved(links.select("u", "v"), "links")
    mark = None
    while True:
        size = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (size["n"], size["h"]) == mark or not size["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, parts = (size["n"], size["h"]), 2 * size["n"] // LINKS_A_FILE
        both = now.union(now.select("v", "u"))
        low = saved(gathered(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), parts), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", "m")).distinct()
        large = saved(gathered(large, parts), "links")
        low = saved(gathered(large.groupBy("u").agg(F.min("v").alias("m")), parts), "low")
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        now = saved(gathered(small.distinct(), parts), "links")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, bands: int = 16, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs (doc_id, text).

    Documents are linked when 100 * common >= percent * all of their k-word shingles. Documents with equal sets are one class,
    and only classes are compared. Band keys bring classes together. First each class meets its key's smallest and largest
    class only; links are confirmed on full sets and joined to components. A key whose classes all are in one component is
    done, however many they are. The classes with any other key meet again where their full sets have a rare shingle in common,
    by a filter that leaves out no pair that is alike enough (`_close`). So every pair with a common key that could join two
    components is tried. At a similarity of 0.8 and 32 keys of 5 rows, a pair has no common key with a probability of 3e-6.

    Null, empty and blank texts have an empty set and no links. Rows with equal ids are one node. A null doc_id can't be
    pointed to: such rows are linked with nothing and have a null component_id and kept true. A very long text is one set, whose
    task needs some 40 bytes for each of its bytes. An empty table gives none. Column names besides the two don't matter.
    """
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    parts_ = parts_of(docs)
    few = lambda table, label: saved(gathered(table, parts_), label)
    sig = saved(signatures(docs, k, bands, rows), "signatures")
    ids = sig.where("n > 0 AND doc_id IS NOT NULL")
    classes = few(ids.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    keyed = classes.select(F.explode("bands").alias("key"), "digest")
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = few(keyed.join(often, "key", "left_semi").join(classes.select("digest", "rep", "n"), "digest"), "keys")
    sets = _sets_of(docs, met.select(F.col("rep").alias("doc_id"), "digest"), k, "met")

    def pairs(a: str, b: str, rows: DataFrame) -> DataFrame:
        side = [F.col(f"{x}.{f}").alias(f"{y}") for x, s in ((a, "a"), (b, "b")) for f, y in (("digest", s), ("rep", f"doc_{s}"), ("n", f"n_{s}"))]
        p = rows.select(*side).where(f"a <> b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        ordered = p.where("a < b").unionByName(p.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
        return ordered.distinct()

    ends = met.groupBy("key").agg(F.min(F.struct("rep", "digest", "n")).alias("lo"), F.max(F.struct("rep", "digest", "n")).alias("hi"))
    own = met.select("key", F.struct("rep", "digest", "n").alias("own")).join(ends, "key")
    stars = few(pairs("lo", "own", own).union(pairs("hi", "own", own)).distinct(), "stars")
    links = _linked(sets, stars, percent, "stars", parts_)
    again = ids.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id")
    same = ids.join(again, "doc_id").join(classes.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.greatest("doc_id", "rep").alias("u"), F.least("doc_id", "rep").alias("v"))
    links = few(links.union(same).distinct(), "first-links")
    parts = components(links)

    placed = met.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    open_ = placed.join(mixed, "key", "left_semi").select("rep", "digest", "n", "part").distinct()
    open_ = few(open_, "open")
    more = few(pairs("a", "b", _close(open_, sets, percent)).join(stars.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    found = _linked(sets, more, percent, "rest", parts_)
    final = components(links.union(found).distinct()) if found.limit(1).count() else parts

    out = sig.select("doc_id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left")
    out = out.withColumn("rep", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")))
    out = out.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(w)]
                     ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(w[i:i + 3]))) END AS s FROM w),
c AS (SELECT min(doc_id) AS rep, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT rep, unnest(s) AS x, len(s) AS n FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT rep AS node, rep AS reach FROM c UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a),
m AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
k AS (SELECT s.doc_id, len(s.s) AS n, min(s.doc_id) OVER (PARTITION BY list_sort(s.s)) AS rep FROM s)
SELECT k.doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN k.doc_id ELSE component END AS component_id,
       k.doc_id = CASE WHEN n = 0 THEN k.doc_id ELSE component END AS kept
FROM k LEFT JOIN m ON m.node = k.rep
"""
