"""An n-gram model with Katz backoff, trained and evaluated over all documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from . import words as W
from .scratch import spread

# Hashes of the document's begin (a history only) and end (a token).
BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFBAF2D1B)
LARGE = 5  # counts above it aren't discounted
#: Bytes of text in a batch: the larger, the fewer batches send the same n-gram.
BATCH_BYTES = 8 << 20
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: What the exchanges save, partitioned by kind: answers for batches, the model's sums, and its tables: n-grams with their
#: counts (one row a bucket, `batch` is the order), and histories with count, backoff weight and factor. A stored model has the
#: last three, and its shape: order and number of buckets.
_TOLD = "kind string, batch long, bucket long, answer binary, sums array<long>"


def _joined(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return W.mix(history * np.uint64(0x9FB21C651E98DF25) + token * np.uint64(0xD6E8FEB86659FD93))


class Grams:
    """The distinct n-grams of one order in a batch. keys: their hashes; place: of each token, that of the n-gram it ends;
    history, lower: of each n-gram, the places of its history and of itself without its first word among those one shorter;
    count: occurrences in training documents; begin: the place of the history that documents begin with, which is no n-gram."""

    def __init__(self, hashes: np.ndarray, begin: np.uint64, train: np.ndarray, shorter: Grams | None, first: np.ndarray) -> None:
        self.keys, where, inverse = np.unique(np.append(hashes, begin), return_index=True, return_inverse=True)
        self.place, self.begin = inverse[:-1], int(inverse[-1])
        self.count = np.bincount(self.place[train], minlength=len(self.keys)).astype(np.int64)
        if shorter is not None:
            before = np.empty_like(shorter.place)
            before[1:] = shorter.place[:-1]
            before[first] = shorter.begin
            where = np.minimum(where, max(0, len(hashes) - 1))  # begin's own are never asked for
            self.history, self.lower = before[where], shorter.place[where]


class Tokens:
    """A batch as n-grams of the orders 1 to `order`; a document's last token is its end."""

    def __init__(self, payload: bytes, order: int) -> None:
        table = B.unpacked(payload)
        scanned = B.scan(table.column("text"), True)
        self.ids, self.held_out = table.column("doc_id").to_pylist(), np.array(table.column("held_out").to_pylist(), dtype=bool)
        self.count = scanned.count + 1
        self.at = np.cumsum(self.count) - self.count
        self.starts = int((~self.held_out).sum())
        hashes = np.empty(int(self.count.sum()), np.uint64)
        body = np.ones(len(hashes), bool)
        body[self.at + scanned.count] = False
        hashes[body], hashes[~body] = scanned.hash, END
        token, train = hashes, np.repeat(~self.held_out, self.count)
        self.grams: list[Grams] = []
        begin = np.array([BEGIN])
        for m in range(order):
            if m:
                before = np.empty_like(hashes)
                before[1:], before[self.at] = hashes[:-1], begin[0]
                hashes, begin = _joined(before, token), _joined(begin, begin[:1] * 0 + BEGIN)
            self.grams.append(Grams(hashes, begin[0], train, self.grams[-1] if m else None, self.at))
        self.deals: list[B.Deal] = []

    def deal(self, buckets: int) -> list[B.Deal]:
        self.deals = self.deals or [B.dealt(g.keys, buckets) for g in self.grams]
        return self.deals


def _send_counts(t: Tokens, buckets: int):
    """Distinct n-grams of all orders with their counts in training documents (0: only held-out ones have it here)."""
    deals = t.deal(buckets)
    for k in sorted(set().union(*(d.runs for d in deals))):
        parts = []
        for g, d in zip(t.grams, deals):
            mine = d.of(k)
            parts += [B.squeeze_sorted(g.keys[mine]), B.squeeze_planes(g.count[mine])]
        yield k, B.join(parts)


def _merge_counts(bucket, sent):
    """Each batch's n-grams with their counts in all batches; whether another batch has the n-gram, be it in held-out documents
    only; whether the batch is the first that has it in training. And, once, the bucket's part of the model's tables, and its
    sums: for each order tokens, distinct n-grams, and numbers of n-grams by count, up to LARGE + 1."""
    parts, answers, sums = [B.split(x) for _, x in sent], [[] for _ in sent], []
    for m in range(len(parts[0]) // 2):
        keys = [B.expand_sorted(p[2 * m]) for p in parts]
        counts = [B.expand_planes(p[2 * m + 1], np.int64) for p in parts]
        every, where = np.concatenate(keys), np.concatenate(counts)
        distinct, inverse, batches = np.unique(every, return_inverse=True, return_counts=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, where)
        owner = np.full(len(distinct), len(every))
        has = np.flatnonzero(where > 0)
        np.minimum.at(owner, inverse[has], has)
        at = 0
        for a, x in zip(answers, keys):
            mine = inverse[at : at + len(x)]
            a.append(B.squeeze_planes(total[mine]))
            a.append(B.squeeze(np.packbits(np.stack([batches[mine] > 1, owner[mine] == np.arange(at, at + len(x))]))))
            at += len(x)
        by = np.bincount(np.minimum(total, LARGE + 2), minlength=LARGE + 3)
        sums += [int(total.sum()), int((total > 0).sum()), *by[1 : LARGE + 2].tolist()]
        trained = total > 0
        yield "grams", m + 1, bucket, B.join([B.squeeze_sorted(distinct[trained]), B.squeeze_planes(total[trained])]), None
    for (batch, _), a in zip(sent, answers):
        yield "answers", batch, bucket, B.join(a), None
    yield "sums", -1, bucket, None, sums


class Model:
    """Good-Turing discounts of every order and the totals; what else a probability needs are counts and a history's weights."""

    def __init__(self, sums: list[int]) -> None:
        each = LARGE + 3
        by_order = [sums[k : k + each] for k in range(0, len(sums), each)]
        self.tokens, self.words = by_order[0][:2]
        self.discounts = [_discounts(s[2:]) for s in by_order]
        kept = sum(self.discounts[0][r] * r * n for r, n in zip(range(1, LARGE + 1), by_order[0][2:]))
        low = sum(r * n for r, n in zip(range(1, LARGE + 1), by_order[0][2:]))
        mass = (self.tokens - low + kept) / self.tokens if self.tokens else 0.0
        self.unknown = max(1 - mass, 1 / (self.tokens + 1))  # all words that training lacks, as one
        self.level = (1 - self.unknown) / mass if mass else 0.0

    def kept(self, order: int, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.discounts[order - 1][np.minimum(count, LARGE + 1)] * count

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.level * self.kept(1, count) / max(1, self.tokens), self.unknown)

    def chance(self, order: int, g: Grams, total: np.ndarray, count: np.ndarray, backoff: np.ndarray, scale: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Of an order's n-grams (counts: total), from their histories' counts, weights and factors, and the order below."""
        seen = scale[g.history] * self.kept(order, total) / np.maximum(count[g.history], 1)
        return np.where(total > 0, seen, backoff[g.history] * lower[g.lower])

    def frame(self, t: Tokens, words: np.ndarray, chance: np.ndarray) -> pd.DataFrame:
        """SCORES of a batch, from its words' counts and the probabilities of its n-grams."""
        place, last = t.grams[0].place, t.grams[-1].place
        base = np.log10((words + 1) / (self.tokens + self.words + 1))
        frame = pd.DataFrame({"doc_id": t.ids, "held_out": t.held_out, "n_tokens": t.count, "n_known": np.add.reduceat((words > 0).astype(np.int64)[place], t.at), "train_tokens": self.tokens, "base_score": np.add.reduceat(base[place], t.at), "score": np.add.reduceat(np.log10(chance)[last], t.at)})
        return frame.astype({"doc_id": "Int64"})


def _discounts(n: list[int]) -> np.ndarray:
    """Katz's ratios d_r for counts r up to LARGE, 1 above. Where counts of counts are too few for Good-Turing's (not between
    0 and 1), the ratio is that of a fixed discount of a half."""
    out = np.ones(LARGE + 2)
    tail = (LARGE + 1) * n[LARGE] / n[0] if n[0] else 1.0
    for r in range(1, LARGE + 1):
        good = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        d = (good - tail) / (1 - tail) if tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _weights(count: np.ndarray, s: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(backoff weight, factor of the seen n-grams) of histories; one that training lacks leaves all to the lower order."""
    known = count > 0
    n = np.where(known, count, 1)
    left = 1 - s / n
    floor = 1 / (n + 1)
    scale = np.where(left < floor, (1 - floor) * n / np.where(s > 0, s, 1), 1.0)
    left = np.maximum(left, floor)
    return np.where(known, left / np.maximum(1 - u, 1e-300), 1.0), np.where(known, scale, 1.0)


def _code(order: int, bucket: int) -> int:
    return (order << 40) + bucket


class Evaluator:
    """Probabilities of a batch's n-grams, from its answers, order by order. What an order needs of its histories is in
    `count`, `s` and `u` (this batch's own sums), and after the exchange in `backoff` and `scale`. whole: all histories that
    training has are exchanged, so that a table gets them, and not only those that several batches have."""

    def __init__(self, t: Tokens, model: Model, told: dict[int, bytes], buckets: int, whole: bool = False) -> None:
        self.t, self.model, self.told, self.deals, self.whole = t, model, told, t.deal(buckets), whole
        self.totals = [np.zeros(len(g.keys), np.int64) for g in t.grams]
        self.shared, self.own = ([np.zeros(len(g.keys), bool) for g in t.grams] for _ in range(2))
        for k, data in told.items():
            if k < _code(1, 0):
                parts = B.split(data)
                for m, d in enumerate(self.deals):
                    mine = d.of(k)
                    self.totals[m][mine] = B.expand_planes(parts[2 * m], np.int64)
                    bits = np.unpackbits(B.expand(parts[2 * m + 1], np.uint8), count=2 * len(mine)).reshape(2, -1).astype(bool)
                    self.shared[m][mine], self.own[m][mine] = bits
        self.chance = model.unigram(self.totals[0])

    def histories(self, order: int) -> None:
        """Counts of the order's histories, and S and U of the n-grams that this batch owns; which of them need an exchange."""
        g = self.t.grams[order - 1]
        own, n = self.own[order - 1], len(self.t.grams[order - 2].keys)
        self.count = self.totals[order - 2].copy()
        self.s = np.bincount(g.history[own], weights=self.model.kept(order, self.totals[order - 1])[own], minlength=n)
        self.u = np.bincount(g.history[own], weights=self.chance[g.lower][own], minlength=n)
        begin = self.t.grams[order - 2].begin
        self.needs = (self.shared[order - 2] | self.whole) & (self.count > 0)
        self.needs[begin] = True  # all documents begin: its count is summed in the exchange
        self.count[begin] = self.t.starts

    def sent(self, order: int):
        g = self.t.grams[order - 2]
        for k, run in self.deals[order - 2].runs.items():
            mine = self.deals[order - 2].order[run]
            mine = mine[self.needs[mine]]
            if len(mine):
                yield _code(order, k), B.join([B.squeeze_sorted(g.keys[mine]), B.squeeze_planes(self.count[mine]), B.squeeze_planes(self.s[mine]), B.squeeze_planes(self.u[mine])])

    def step(self, order: int) -> None:
        """From the probabilities of the order below to this one's."""
        self.histories(order)
        backoff, scale = _weights(self.count, self.s, self.u)
        for k, run in self.deals[order - 2].runs.items():
            data = self.told.get(_code(order, k))
            if data is not None:
                mine = self.deals[order - 2].order[run]
                mine = mine[self.needs[mine]]
                a, b, c = B.split(data)
                backoff[mine], scale[mine], self.count[mine] = B.expand_planes(a, np.float64), B.expand_planes(b, np.float64), B.expand_planes(c, np.int64)
        self.chance = self.model.chance(order, self.t.grams[order - 1], self.totals[order - 1], self.count, backoff, scale, self.chance)


def _merge_weights(begin: np.uint64, order: int):
    def merge(bucket, sent):
        parts = [B.split(x) for _, x in sent]
        each = [B.expand_sorted(p[0]) for p in parts]
        count = np.concatenate([B.expand_planes(p[1], np.int64) for p in parts])
        distinct, inverse = np.unique(np.concatenate(each), return_inverse=True)
        s, u = (np.bincount(inverse, weights=np.concatenate([B.expand_planes(p[k], np.float64) for p in parts]), minlength=len(distinct)) for k in (2, 3))
        total = np.zeros(len(distinct), np.int64)
        np.maximum.at(total, inverse, count)
        first = np.flatnonzero(distinct == begin)
        total[first] = count[np.isin(inverse, first)].sum()
        backoff, scale = _weights(total, s, u)
        at = 0
        for (batch, _), x in zip(sent, each):
            mine = inverse[at : at + len(x)]
            yield "answers", batch, bucket, B.join([B.squeeze_planes(backoff[mine]), B.squeeze_planes(scale[mine]), B.squeeze_planes(total[mine])]), None
            at += len(x)
        yield "histories", order, bucket, B.join([B.squeeze_sorted(distinct), *(B.squeeze_planes(x) for x in (total, backoff, scale))]), None

    return merge


def _texts(docs: DataFrame, held_out) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), held_out.alias("held_out"))


def _model(tables: DataFrame, order: int) -> Model:
    """From the buckets' sums; there are as many numbers as orders ask for, however many buckets."""
    sums = tables.where("kind = 'sums'").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    return Model([r["n"] for r in sums] or [0] * (order * (LARGE + 3)))


def _learned(table: DataFrame, buckets: int, order: int, whole: bool) -> tuple[Model, DataFrame, list[DataFrame]]:
    """(model, answers for the batches, all that the exchanges saved)."""
    saved = [B.exchange(table, buckets, lambda p, _: _send_counts(Tokens(p, order), buckets), _merge_counts, "counts", None, _TOLD, ("kind",))]
    model, answers = _model(saved[0], order), lambda x: x.where("kind = 'answers'").select("batch", "bucket", "answer")
    told = answers(saved[0])

    def sender(upto: int):
        def send(payload, answers):
            e = Evaluator(Tokens(payload, order), model, answers, buckets, whole)
            for m in range(2, upto):
                e.step(m)
            e.histories(upto)
            yield from e.sent(upto)

        return send

    begin = np.array([BEGIN])
    for m in range(2, order + 1):
        saved.append(B.exchange(table, buckets, sender(m), _merge_weights(begin[0], m), f"weights{m}", told, _TOLD, ("kind",)))
        told = told.unionByName(answers(saved[-1]))
        begin = _joined(begin, np.array([BEGIN]))
    return model, told, saved


def train_and_score(docs: DataFrame, held_out, order: int = 2) -> DataFrame:
    """SCORES per row of docs (doc_id, text): trained on the documents that held_out(doc_id) doesn't hold.

    Tokens: words in lower case (A-Z only), then one end; a document's begin, as often as needed, is the first tokens'
    history. Counts of n-grams of all orders are gathered from all batches, hashed on the n-gram; a batch sends each of its own
    once. A batch gets the merged counts of its own n-grams.
    Unigrams are discounted by Good-Turing, and all unknown words share what is left. For every order above, a seen n-gram has
    its discounted share of its history's count, an unseen one the history's backoff weight times the probability one order
    lower, and so on down. Backoff weights are exact: the seen n-grams of a history leave 1 - S, and 1 - U of the order below,
    where both sums run over its n-grams, each counted once by the first batch that has it. Where a history's n-grams are all
    too frequent to be discounted, they yield 1 / (count + 1) in proportion. Histories that only one batch has, held-out
    documents included, need no exchange: their weights are made where they are used.

    Null and empty texts are the end alone. A null doc_id is hashed as an empty text. Repeated rows count as often as they
    are there. A very long text is a batch of its own: a task needs some 20 bytes for each of its bytes. Without training
    documents every token is unknown (probability 1). An empty table gives none. Column names besides the two don't matter.
    """
    table, buckets = B.batched(_texts(docs, held_out(docs["doc_id"])), "katz", BATCH_BYTES)
    model, told, _ = _learned(table, buckets, order, False)

    def score(key: tuple | None, payload: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in payload["payload"]:
            e = Evaluator(Tokens(p, order), model, B.by_bucket(answers), buckets)
            for m in range(2, order + 1):
                e.step(m)
            out.append(model.frame(e.t, e.totals[0], e.chance))
        W.release()
        return pd.concat(out)

    return B.met(table, told, score, SCORES)


def train(docs: DataFrame, path: str, order: int = 2) -> None:
    """The same model of all docs (doc_id, text), stored at path: n-grams with their counts and all histories with their counts
    and weights, a row for each order and bucket of hashes, partitioned by kind. An empty table gives a model without words."""
    table, buckets = B.batched(_texts(docs, F.lit(False)), "katz", BATCH_BYTES)
    _, _, saved = _learned(table, buckets, order, True)
    shape = docs.sparkSession.createDataFrame([("shape", -1, -1, None, [order, buckets])], _TOLD)
    for some in saved:
        shape = shape.unionByName(some.where("kind <> 'answers'"))
    shape.withColumn("bucket", F.expr(f"IF(kind = 'histories', bucket & {_code(1, 0) - 1}, bucket)")).write.mode("overwrite").partitionBy("kind").parquet(path)


def _send_keys(t: Tokens, buckets: int):
    deals = t.deal(buckets)
    for k in sorted(set().union(*(d.runs for d in deals))):
        yield k, B.join([B.squeeze_sorted(g.keys[d.of(k)]) for g, d in zip(t.grams, deals)])


def _found(keys: np.ndarray, table: np.ndarray, values: np.ndarray, otherwise: int) -> np.ndarray:
    """The values of keys in a table of rising keys."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return np.where(table[at] == keys, values[at], otherwise) if len(table) else np.full(len(keys), otherwise, values.dtype)


def _answer_keys(order: int):
    """For each batch, order by order: counts of its n-grams; and below the highest, their counts, weights and factors as
    histories."""
    kinds = (np.int64, np.int64, np.float64, np.float64)

    def answer(sent: list[tuple[int, bytes]], kept: pd.DataFrame):
        stored = {(k, m): B.split(data) for k, m, data in zip(kept["kind"], kept["batch"].tolist(), kept["answer"])}
        tables = []
        for m in range(1, order + 1):
            for k, columns in [(("grams", m), kinds[:1]), (("histories", m + 1), kinds[1:])][: 2 if m < order else 1]:
                parts = stored.get(k)
                keys = B.expand_sorted(parts[0]) if parts else np.zeros(0, np.uint64)
                values = [B.expand_planes(x, c) for x, c in zip(parts[1:], columns)] if parts else [np.zeros(0, c) for c in columns]
                tables += [(m, keys, v, 0 if c is np.int64 else 1) for v, c in zip(values, columns)]
        for batch, data in sent:
            asked = [B.expand_sorted(x) for x in B.split(data)]
            yield batch, B.join([B.squeeze_planes(_found(asked[m - 1], keys, v, rest)) for m, keys, v, rest in tables])

    return answer


def score(path: str, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of any texts (doc_id, text) by a model that `train` has stored.

    Texts become batches, which send their distinct n-grams to the tables' buckets and get what these hold of them; the
    recursion runs in the batch. Nothing of the model but its totals goes through the driver. Words and histories that the
    model lacks back off as in training. Nulls, empty texts, repeated rows and long texts: as there; an empty table gives none.
    """
    tables = docs.sparkSession.read.schema(_TOLD).parquet(path)
    order, buckets = tables.where("kind = 'shape'").first()["sums"]
    model = _model(tables, order)
    table, own = B.batched(_texts(docs, F.lit(True)), "scored", BATCH_BYTES)
    told = B.consult(table, buckets, -(-own // buckets), lambda p, _: _send_keys(Tokens(p, order), buckets), tables.where("kind IN ('grams', 'histories')").select("kind", "batch", "bucket", "answer"), _answer_keys(order), "looked-up")

    def scored(key: tuple | None, payload: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in payload["payload"]:
            t = Tokens(p, order)
            found = [[np.zeros(len(g.keys), c) for c in (np.int64, np.int64, np.float64, np.float64)] for g in t.grams]
            for k, data in B.by_bucket(answers).items():
                parts = iter(B.split(data))
                for g, d in zip(found, t.deal(buckets)):
                    for column, x in zip(g if g is not found[-1] else g[:1], parts):
                        column[d.of(k)] = B.expand_planes(x, column.dtype)
            chance = model.unigram(found[0][0])
            for m in range(2, order + 1):
                chance = model.chance(m, t.grams[m - 1], found[m - 1][0], *found[m - 2][1:], chance)
            out.append(model.frame(t, found[0][0], chance))
        W.release()
        return pd.concat(out)

    return B.met(table, told, scored, SCORES).drop("held_out")


def held_out(doc_id, parts: int = 7, rest: int = 2):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == rest


def query(spark, sf_dir: str) -> DataFrame:
    return train_and_score(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), held_out)
