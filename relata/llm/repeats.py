"""Substring dedup: suffixes split by prefixes into groups, whose subtrees' deep nodes are the repeated passages."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import batches as B
from . import words as W
from .scratch import spread

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LAST = np.int64(2**63 - 1)
REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Suffixes that one prefix may have before its suffixes are split by a longer one.
MOST_SUFFIXES = 1 << 20


def _suffixes(scanned: W.Words, depth: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, prefix, path) of each suffix with at least `depth` words: hashes of the prefix that it is grouped by,
    the least of the `prefix`-word runs in its first `depth` words, and of all of these (the path from the root)."""
    path, at = W.windows(scanned, depth, 11)
    short, _ = W.windows(scanned._replace(count=np.array([len(scanned.hash)]), at=np.zeros(1, np.int64)), prefix, 13)
    least, span, want = short, 1, depth - prefix + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    text = np.repeat(np.arange(len(scanned.count)), scanned.count)[at]
    return text, at, W.mix(least[at]), path


def _ids(table) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)


class Runs:
    """What a batch sends in the second exchange: its distinct runs. A run is one or more suffixes that begin at words in
    sequence and have the same prefix; under a long prefix each suffix is a run of its own. A run goes with its words once,
    for the least document that has it; `run` and `least` are of each suffix."""

    def __init__(self, at: np.ndarray, key: np.ndarray, path: np.ndarray, alone: np.ndarray, doc: np.ndarray) -> None:
        n = len(at)
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1]) | alone[1:] | alone[:-1] | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        mine = np.cumsum(new) - 1
        size = np.diff(np.append(first, n))
        inside = np.arange(n) - first[mine]
        whole = W.mix(np.add.reduceat(path * W.weights(int(inside.max()) + 1, 41)[inside], first) + size.astype(np.uint64)) if n else np.zeros(0, np.uint64)
        _, where, inverse = np.unique(whole, return_index=True, return_inverse=True)
        self.least_of = np.full(len(where), _LAST)
        np.minimum.at(self.least_of, inverse, doc[first])
        self.first, self.size, self.key = at[first[where]], size[where], key[first[where]]
        self.run = inverse[mine]
        self.least = self.least_of[self.run]
        self.place = (np.cumsum(self.size) - self.size)[self.run] + inside  # of each suffix among those of all distinct runs


def tree_nodes(symbols: np.ndarray, at: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix (its place among the symbols, its document) the least document below its node at `depth`.

    The suffixes' tree is refined from the root down, by doubling: the nodes at depth 2 d are the pairs of nodes at depth d that
    a suffix and its continuation pass. Suffixes under a node of one document only are at a leaf, and go no deeper.
    """
    level, reach = np.unique(symbols, return_inverse=True)[1].astype(np.uint64), 1
    least, alive = doc.copy(), np.arange(len(at))
    while reach < depth and len(alive):
        step = min(reach, depth - reach)
        after = np.append(level[step:], np.zeros(step, np.uint64))
        level = np.unique((level << np.uint64(32)) | after, return_inverse=True)[1].astype(np.uint64)
        reach += step
        node = level[at[alive]].astype(np.int64)
        low, high = np.full(len(level) and int(level.max()) + 1, _LAST), np.full(len(level) and int(level.max()) + 1, -_LAST)
        np.minimum.at(low, node, doc[alive])
        np.maximum.at(high, node, doc[alive])
        if reach == depth:
            least[alive] = low[node]
        alive = alive[low[node] != high[node]]
    return least


def repeats(docs: DataFrame, depth: int = 13, prefix: int = 4, finish=None, result=REMOVED, most: int = MOST_SUFFIXES) -> DataFrame:
    """Removes from each document the words of every `depth`-word window that also starts in a document with a smaller id.

    docs: doc_id, text, and any more columns. A suffix counts to `depth` words, the depth that decides. Suffixes are grouped
    by a prefix at a place that the words themselves choose (the least `prefix`-word run among the first `depth` words), so
    that equal passages agree, and neighbours mostly share it: they are sent as one run of words. In the first exchange the
    prefixes' sizes are summed. One that a single document has leads to no inner node, and its suffixes are done; one that more
    than `most` suffixes have is lengthened to all `depth` words. In the second exchange the runs of the others go to their
    prefix's group, as 32-bit symbols; a task sorts the groups of one range of prefixes into their subtrees, and inner nodes at
    full depth tell each suffix the least document below. A batch sends a run once, however often it has it.

    Null and empty texts have no words; a null doc_id counts as the largest, so such rows' passages go wherever another row
    has them, and never count as earlier ones. Rows with equal ids don't take from each other. Documents with fewer than
    `depth` words are kept whole. Any more columns may have any names. A very long text is a batch of its own: a task needs some
    20 bytes for each of its bytes. An empty table gives none. finish(table of the batch, its words, kept mask) makes the rows of `result`; without it they are
    REMOVED.
    """
    table, buckets = B.batched(docs.select(*[docs[c] for c in docs.columns]), "repeats")

    class Batch:
        """A batch's suffixes: all, then (told the first answers) those alive, and their runs."""

        def __init__(self, payload: bytes, told: dict[int, bytes] | None) -> None:
            self.table = B.unpacked(payload)
            self.scanned = B.scan(self.table.column("text"), False)
            text, at, short, path = _suffixes(self.scanned, depth, prefix)
            doc = _ids(self.table)[text]
            self.keys, where, inverse, self.sizes = np.unique(short, return_index=True, return_inverse=True, return_counts=True)
            self.several = np.zeros(len(self.keys), bool)  # two documents of this batch have it
            self.several[inverse[doc != doc[where][inverse]]] = True
            self.deal = B.dealt(self.keys, buckets)
            if told is None:
                return
            bits = np.zeros((2, len(self.keys)), bool)
            for k, run in self.deal.runs.items():
                mine = self.deal.order[run]
                bits[:, mine] = np.unpackbits(np.frombuffer(told[k], np.uint8), count=2 * len(mine)).reshape(2, -1)
            live = (bits[0] | self.several)[inverse] if len(inverse) else np.zeros(0, bool)
            long = bits[1][inverse][live]
            self.at, self.doc = at[live], doc[live]
            self.runs = Runs(self.at, np.where(long, path[live], short[live]), path[live], long, self.doc)
            self.by_run = B.dealt(self.runs.key, buckets)

    def send_sizes(payload, told):
        b = Batch(payload, None)
        for k, run in b.deal.runs.items():
            mine = b.deal.order[run]
            yield k, B.join([B.squeeze_sorted(b.keys[mine]), B.squeeze(b.sizes[mine].astype(np.uint32))])

    def merge_sizes(bucket, sent):
        parts = [B.split(x) for _, x in sent]
        each = [B.expand_sorted(p[0]) for p in parts]
        _, inverse, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        size = np.bincount(inverse, weights=np.concatenate([B.expand(p[1], np.uint32) for p in parts]))
        at = 0
        for (batch, _), x in zip(sent, each):
            mine = inverse[at : at + len(x)]
            yield batch, bucket, np.packbits(np.stack([count[mine] > 1, size[mine] > most])).tobytes()
            at += len(x)

    def send_runs(payload, told):
        b = Batch(payload, told)
        symbols = (b.scanned.hash >> np.uint64(32)).astype(np.uint32)
        for k, run in b.by_run.runs.items():
            mine = b.by_run.order[run]
            size = b.runs.size[mine] + depth - 1
            words = np.repeat(b.runs.first[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            yield k, B.join([symbols[words].tobytes(), B.squeeze(size.astype(np.uint32)), B.squeeze(b.runs.least_of[mine])])

    def merge_runs(bucket, sent):
        parts = [B.split(x) for _, x in sent]
        symbols = np.concatenate([np.frombuffer(p[0], np.uint32) for p in parts])
        sizes, docs_ = [B.expand(p[1], np.uint32).astype(np.int64) for p in parts], [B.expand(p[2], np.int64) for p in parts]
        size, doc = np.concatenate(sizes), np.concatenate(docs_)
        n = size - depth + 1  # suffixes of each run
        at = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        doc = np.repeat(doc, n)
        earlier = tree_nodes(symbols, at, doc, depth) < doc
        done = 0
        for (batch, _), s in zip(sent, sizes):
            here = int((s - depth + 1).sum())
            yield batch, -1 - bucket, np.packbits(earlier[done : done + here]).tobytes()
            done += here

    first = B.exchange(table, buckets, send_sizes, merge_sizes, "prefixes")
    second = B.exchange(table, buckets, send_runs, merge_runs, "runs", first)
    finish = finish or digests

    def remove(key: tuple | None, payload: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told, out = B.by_bucket(told), []
        for p in payload["payload"]:
            b = Batch(p, told)
            r = b.runs
            earlier, begin = np.zeros(int(r.size.sum()), bool), np.cumsum(r.size) - r.size
            for k, run in b.by_run.runs.items():
                mine = b.by_run.order[run]
                n = r.size[mine]
                to = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                earlier[to] = np.unpackbits(np.frombuffer(told[-1 - k], np.uint8), count=len(to)).astype(bool)
            hit = b.at[earlier[r.place] | (r.least < b.doc)] if len(b.at) else b.at
            change = np.zeros(len(b.scanned.hash) + 1, np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + depth, -1)
            out.append(finish(b.table, b.scanned, np.cumsum(change)[:-1] == 0))
        W.release()
        return pd.concat(out)

    return B.met(table, first.unionByName(second), remove, result)


def _kept_words(text: str | None, kept: np.ndarray) -> list[str]:
    found = _WORD.findall(text or "")
    return found if kept.all() else [w for w, k in zip(found, kept.tolist()) if k]


def digests(rows, scanned: W.Words, kept: np.ndarray) -> pd.DataFrame:
    """REMOVED rows of a batch."""
    out = []
    for doc, text, at, n in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), scanned.at.tolist(), scanned.count.tolist()):
        left = _kept_words(text, kept[at : at + n])
        out.append((doc, n, n - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})


def without_repeats(docs: DataFrame, depth: int = 13, prefix: int = 4) -> DataFrame:
    """docs with the repeated words gone from text: an unchanged text stays as it is, else one space stands between kept words."""

    def texts(rows, scanned: W.Words, kept: np.ndarray) -> pd.DataFrame:
        frame = rows.to_pandas(integer_object_nulls=True)
        new = []
        for text, at, n in zip(rows.column("text").to_pylist(), scanned.at.tolist(), scanned.count.tolist()):
            mask = kept[at : at + n]
            new.append(text if mask.all() else " ".join(_kept_words(text, mask)))
        frame["text"] = new
        return frame

    return repeats(docs, depth, prefix, texts, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


SQL = r"""
WITH t AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM t),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM s),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) < doc_id AS dup FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM m WHERE dup),
r AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, t.w, coalesce(r.gone, []) AS gone FROM t LEFT JOIN r USING (doc_id)),
x AS (SELECT doc_id, w, list_filter(w, lambda e, i: NOT list_contains(gone, i)) AS kept FROM k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM x
"""
