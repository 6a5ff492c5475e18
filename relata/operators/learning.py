"""Attention-pooled classifiers and boosted trees in numpy, their stored models, and searches over both."""

from __future__ import annotations

import functools
import io
import itertools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import batches_of, saved
from . import pooling

#: Labelled rows that one task may learn trees from. Of more, equal ones are counted; if more than so many differ, MLlib learns
#: from them, in a distributed way, where it is asked to.
MOST_ROWS = 1_000_000
#: Ids whose embeddings are one row of a model in blocks.
BLOCK = 4096
#: Ids of a mini-batch whose vectors are made at a time, and bytes of what goes to a task that learns at a time.
STEP, BATCH = 16_384, 4 << 20
BLOCKS = "bag int, at int, numbers binary"
# What is searched for classifiers (dropout, hidden units, sizes of embeddings and of attention embeddings), and
# for scorers (share of rows, least rows of a split, depth, rate; features from three up).
CLASSIFIER_SPACE = {"dropout": [round(0.05 * n, 2) for n in range(1, 21)], "hidden": [500 * n for n in range(1, 21)], "dim": [100, 150, 200], "attention_dim": [2 * n for n in range(1, 11)]}
PREDICTIONS = "title string, type_name string, fold int, label double, prediction double"
SCORER_SPACE = {"subsample": [round(0.05 * n, 2) for n in range(1, 21)], "min_split": list(range(2, 101)), "depth": list(range(1, 7)), "rate": [round(0.01 + 0.005 * n, 3) for n in range(19)]}


class Classifier:
    """Bags of word and entity ids to types: the embeddings of each bag pooled by attention weights and made a unit vector, both
    (or one of them: use="words" or "entities") end to end, then a hidden layer, dropout, and softmax.

    Pooling sums exp(a_i) e_i over ids other than 0, with a_i the product of the id's attention embedding and one vector. The
    softmax over places is left out: its denominator is one factor of the sum, which the unit length takes away again.
    attention=False gives every id the same weight. Trained by Adam in mini-batches; embeddings move where a batch has their id.
    """

    def __init__(self, words: int, entities: int, classes: int, dim: int = 100, hidden: int = 2000, attention: bool = True, attention_dim: int = 10, dropout: float = 0.5, use: str = "both", seed: int = 0) -> None:
        self.shape = {"words": words, "entities": entities, "classes": classes, "dim": dim, "hidden": hidden, "attention": attention, "attention_dim": attention_dim, "dropout": dropout, "use": use, "seed": seed}
        self.bags = [(k, n) for k, n, name in ((0, words, "words"), (1, entities, "entities")) if use in ("both", name)]
        self.attention, self.dropout, self.dim = attention, dropout, dim
        rng = np.random.default_rng(seed)
        glorot = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        self.p = {}
        for k, n in self.bags:
            self.p[f"e{k}"] = rng.uniform(-0.05, 0.05, (n + 1, dim))
            if attention:
                self.p[f"a{k}"], self.p[f"d{k}"] = rng.uniform(-0.05, 0.05, (n + 1, attention_dim)), glorot(attention_dim, 1)[:, 0]
        self.p |= {"w1": glorot(dim * len(self.bags), hidden), "b1": np.zeros(hidden), "w2": glorot(hidden, classes), "b2": np.zeros(classes)}
        self.moments, self.steps = {}, 0

    def _pool(self, k: int, rows: list):
        """(ids of all rows but 0, the row of each, weights, unit vectors, their lengths)."""
        flat = [np.asarray(r, dtype=np.int64) for r in rows]
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in flat])
        row, ids = row[ids != 0], ids[ids != 0]
        w = np.ones(len(ids))
        if self.attention and len(ids):
            a = self.p[f"a{k}"][ids] @ self.p[f"d{k}"]
            top = np.full(len(rows), -np.inf)
            np.maximum.at(top, row, a)
            w = np.exp(a - top[row])
        v = np.zeros((len(rows), self.dim))
        if len(ids):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            v[row[first]] = _sums(first, len(ids), lambda at: w[at, None] * self.p[f"e{k}"][ids[at]])
        size = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-7)
        return ids, row, w, v / size, size

    def logits(self, words: list, entities: list) -> np.ndarray:
        x = np.hstack([self._pool(k, (words, entities)[k])[3] for k, _ in self.bags])
        return np.maximum(x @ self.p["w1"] + self.p["b1"], 0) @ self.p["w2"] + self.p["b2"]

    def measured(self, rows: list[list], labels: np.ndarray, batch: int = 500) -> tuple[float, float]:
        """(loss, accuracy)."""
        loss, right = 0.0, 0
        for at in range(0, len(labels), batch):
            z = self.logits(*(r[at : at + batch] for r in rows))
            y = labels[at : at + batch]
            z = z - z.max(axis=1, keepdims=True)
            loss += float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).sum())
            right += int((z.argmax(axis=1) == y).sum())
        return loss / max(1, len(labels)), right / max(1, len(labels))

    def fit(self, words: list, entities: list, labels, weights=None, dev: tuple | None = None, epochs: int = 1, batch: int = 100, rate: float = 0.001, seed: int = 0, measure: bool = True) -> list[dict]:
        """The history, if measured: for each epoch loss and accuracy, and with dev (words, entities, labels) those there."""
        rng, labels, history = np.random.default_rng(seed), np.asarray(labels, dtype=np.int64), []
        weights = np.ones(len(labels)) if weights is None else np.asarray(weights, dtype=float)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                mine = order[at : at + batch]
                self._step([[r[k] for k in mine] for r in (words, entities)], labels[mine], weights[mine], rate, rng)
            if not measure:
                continue
            loss, accuracy = self.measured([words, entities], labels)
            history.append({"loss": loss, "acc": accuracy})
            if dev is not None:
                history[-1] |= dict(zip(("val_loss", "val_acc"), self.measured(list(dev[:2]), np.asarray(dev[2], dtype=np.int64))))
        return history

    def _step(self, rows: list[list], labels: np.ndarray, weights: np.ndarray, rate: float, rng) -> None:
        pools = {k: self._pool(k, rows[k]) for k, _ in self.bags}
        x = np.hstack([pools[k][3] for k, _ in self.bags])
        h = np.maximum(x @ self.p["w1"] + self.p["b1"], 0)
        kept = (rng.random(h.shape) >= self.dropout) / (1 - self.dropout) if 0 < self.dropout < 1 else 1.0
        z = (h * kept) @ self.p["w2"] + self.p["b2"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(labels)), labels] -= 1
        z *= weights[:, None] / len(labels)
        dh = (z @ self.p["w2"].T) * kept * (h > 0)
        change = {"w2": (h * kept).T @ z, "b2": z.sum(axis=0), "w1": x.T @ dh, "b1": dh.sum(axis=0)}
        dx = dh @ self.p["w1"].T
        self.steps += 1
        for n, (k, _) in enumerate(self.bags):
            ids, row, w, unit, size = pools[k]
            if not len(ids):
                continue
            dv = dx[:, n * self.dim : (n + 1) * self.dim]
            dv = (dv - unit * (dv * unit).sum(axis=1, keepdims=True)) / size
            distinct, where = np.unique(ids, return_inverse=True)
            order = np.argsort(where, kind="stable")
            first = np.searchsorted(where[order], np.arange(len(distinct)))
            self._adam(f"e{k}", _sums(first, len(ids), lambda at: w[order[at], None] * dv[row[order[at]]]), rate, distinct)
            if self.attention:
                cut = [slice(at, at + STEP) for at in range(0, len(ids), STEP)]
                da = w * np.concatenate([(self.p[f"e{k}"][ids[at]] * dv[row[at]]).sum(axis=1) for at in cut])
                change[f"d{k}"] = self.p[f"a{k}"][ids].T @ da
                self._adam(f"a{k}", _sums(first, len(ids), lambda at: da[order[at], None] * self.p[f"d{k}"]), rate, distinct)
        for name, g in change.items():
            self._adam(name, g, rate, slice(None))

    def _adam(self, name: str, g: np.ndarray, rate: float, at) -> None:
        if name not in self.moments:
            self.moments[name] = np.zeros((2, *self.p[name].shape))
        m, v = self.moments[name]
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.999 * v[at] + 0.001 * g * g
        self.p[name][at] -= rate * (m[at] / (1 - 0.9**self.steps)) / (np.sqrt(v[at] / (1 - 0.999**self.steps)) + 1e-8)

    def _rest(self) -> list[str]:
        return [n for n in self.p if n[0] not in "ea"]

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bag, first id, numbers) of BLOCK ids each: their embeddings, each with its attention embedding behind it; and as bag -1
        all other numbers."""
        for k, n in self.bags:
            for at in range(0, n + 1, BLOCK):
                yield k, at, np.hstack([self.p[x][at : at + BLOCK] for x in (f"e{k}", f"a{k}") if x in self.p])
        yield -1, 0, np.concatenate([self.p[n].ravel() for n in self._rest()])

    def put(self, bag: int, at: int, numbers: np.ndarray) -> None:
        """A block's numbers in place of those that are there."""
        if bag >= 0:
            rows = numbers.reshape(-1, sum(self.p[x].shape[1] for x in (f"e{bag}", f"a{bag}") if x in self.p))
            self.p[f"e{bag}"][at : at + len(rows)] = rows[:, : self.dim]
            if self.attention:
                self.p[f"a{bag}"][at : at + len(rows)] = rows[:, self.dim :]
            return
        for n in self._rest():
            self.p[n], numbers = numbers[: self.p[n].size].reshape(self.p[n].shape).astype(float), numbers[self.p[n].size :]

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, shape=np.frombuffer(json.dumps(self.shape).encode(), np.uint8), **{k: v.astype(np.float32) for k, v in self.p.items()})
        return zlib.compress(out.getvalue(), 1)

    @classmethod
    def loads(cls, data: bytes) -> Classifier:
        with np.load(io.BytesIO(zlib.decompress(data))) as stored:
            model = cls.__new__(cls)
            shape = json.loads(stored["shape"].tobytes())
            model.shape, model.p = shape, {k: stored[k].astype(float) for k in stored.files if k != "shape"}
        model.bags = [(k, shape[name]) for k, name in enumerate(("words", "entities")) if shape["use"] in ("both", name)]
        model.attention, model.dropout, model.dim, model.moments, model.steps = shape["attention"], shape["dropout"], shape["dim"], {}, 0
        return model


def _sums(first: np.ndarray, n: int, rows: Callable[[slice], np.ndarray]) -> np.ndarray:
    """Sums of the runs of n rows that begin at `first`; rows(at) makes those of a slice, runs of about STEP rows at a time."""
    ends, out, k = np.r_[first[1:], n], [], 0
    while k < len(first):
        to = max(k + 1, int(np.searchsorted(ends, first[k] + STEP, side="right")))
        out.append(np.add.reduceat(rows(slice(first[k], ends[to - 1])), first[k:to] - first[k]))
        k = to
    return np.concatenate(out)


class Trained:
    """A classifier whose embeddings stay a table (BLOCKS, of 64-bit floats), as they were trained. The driver reads bag -1 only."""

    def __init__(self, shape: dict, blocks: DataFrame) -> None:
        self.shape, self.blocks = shape, blocks

    def whole(self) -> Classifier:
        """The model itself, for which the driver must have the memory; its blocks are read one at a time."""
        model = Classifier(**self.shape)
        for r in self.blocks.toLocalIterator():
            model.put(r["bag"], r["at"], np.frombuffer(r["numbers"]))
        return model

    def layers(self) -> Classifier:
        """The model without embeddings but those of id 0."""
        model = Classifier(**{**self.shape, "words": 0, "entities": 0})
        model.put(-1, 0, np.frombuffer(self.blocks.where("bag = -1").first()["numbers"]))
        return model


def train_classifier(rows: DataFrame, shape: dict, epochs: int = 1, workers: int = 1, **options) -> Classifier:
    """The model of `train_stored` in the driver, which must be able to hold it."""
    return train_stored(rows, shape, epochs, workers, **options).whole()


def train_stored(rows: DataFrame, shape: dict, epochs: int = 1, workers: int = 1, batch: int = 100, rate: float = 0.001) -> Trained:
    """A model from rows (title, words, entities, label, weight): each round `workers` tasks learn one epoch from their share of
    the rows, from the round's model on, and their models are averaged by their numbers of rows; with one worker it is plain
    training.

    A model is never in the driver: it is made where it is trained, it leaves and comes back as blocks of ids, and those are
    averaged by Spark. Nor does a task hold its rows: Spark sorts them into the epoch's order, which the round and the number of
    rows give, and they go by in mini-batches. So a task has one model, of a size that the vocabularies bound.
    """
    dealt = rows.select(F.pmod(F.hash("title"), F.lit(workers)).alias("worker"), "title", "words", "entities", "label", "weight")
    found = dealt.groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first")).orderBy("first").collect()
    shares, total, blocks = {r["worker"]: r["n"] for r in found}, sum(r["n"] for r in found), None
    for round_ in range(epochs if total else 0):
        examples, before = dealt.selectExpr("*", "cast(null AS int) bag", "cast(null AS int) at", "cast(null AS binary) numbers"), 0
        if blocks is not None:
            before = blocks.count()
            examples = examples.unionByName(blocks.withColumn("worker", F.explode(F.array(*[F.lit(w) for w in shares]))), allowMissingColumns=True)
        named = examples.repartitionById(workers, F.col("worker")).sortWithinPartitions(F.isnull("bag"), "title")
        at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) - before  # a row's number in its task, after the blocks
        placed = named.withColumn("row", at.cast("int")).join(F.broadcast(_places(rows.sparkSession, shares, round_)), "worker")
        placed = placed.withColumn("place", F.when(F.col("row") >= 0, F.get("places", "row"))).drop("row", "places")
        models = placed.sortWithinPartitions(F.asc_nulls_first("place")).mapInArrow(_learning(shape, shares, round_, batch, rate), f"worker int, {BLOCKS}")
        mean = _mean({w: n / total for w, n in shares.items()}, float if round_ == epochs - 1 else np.float32)
        with batches_of(rows.sparkSession, BATCH):
            blocks = saved(models.groupBy("bag", "at").applyInPandas(mean, BLOCKS), "model")
    if blocks is None:
        one = rows.sparkSession.range(0, 1, 1, 1)
        blocks = saved(one.mapInArrow(lambda _: (_block(*b) for b in Classifier(**shape).blocks()), BLOCKS), "model")
    return Trained(shape, blocks)


def _block(bag: int, at: int, numbers: np.ndarray, **more: int) -> pa.RecordBatch:
    ints = {n: pa.array([v], pa.int32()) for n, v in (more | {"bag": bag, "at": at}).items()}
    return pa.RecordBatch.from_pydict(ints | {"numbers": pa.array([numbers.tobytes()], pa.binary())})


def _places(spark: SparkSession, shares: dict[int, int], round_: int) -> DataFrame:
    """worker, places: where a worker's rows, in order of titles, are in the round, 4 bytes a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            places = [np.argsort(np.random.default_rng(round_).permutation(n)).astype(np.int32) for n in f["n"]]
            yield pd.DataFrame({"worker": f["worker"], "places": places})

    return spark.createDataFrame(list(shares.items()), "worker int, n int").mapInPandas(run, "worker int, places array<int>")


def _learning(shape: dict, shares: dict[int, int], round_: int, batch: int, rate: float) -> Callable:
    """The task of one worker: blocks of the round's model, then examples in their order, to blocks of what it has learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        pa.default_memory_pool().release_unused()  # of the process's earlier tasks
        worker, model, rng = first.column("worker")[0].as_py(), Classifier(**shape), np.random.default_rng(round_)
        for v in model.p.values():
            for at in range(0, len(v), BLOCK):
                v[at : at + BLOCK] = v[at : at + BLOCK].astype(np.float32)  # as they are in blocks
        rng.permutation(shares[worker])  # the order of the rows
        for some in itertools.batched(_examples(itertools.chain([first], batches), worker, model), batch):
            words, names, labels, weights = zip(*some)
            model._step([words, names], np.array(labels, np.int64), np.array(weights, float), rate, rng)
        for b in model.blocks():
            yield _block(*b[:2], b[2].astype(np.float32), worker=worker)

    return run


def _examples(batches: Iterator[pa.RecordBatch], worker: int, model: Classifier) -> Iterator[tuple]:
    """(words, entities, label, weight) of rows that are examples; those that are blocks go into the model."""
    for b in batches:
        if pc.any(pc.not_equal(b.column("worker"), worker)).as_py():
            raise ValueError("rows of two workers in one task")
        lists = [(b.column(n).offsets.to_numpy(), pc.fill_null(b.column(n).values, 0).to_numpy()) for n in ("words", "entities")]
        labels, weights, blocks = (b.column(n) for n in ("label", "weight", "bag"))
        for k in range(b.num_rows):
            if blocks[k].is_valid:
                model.put(blocks[k].as_py(), b.column("at")[k].as_py(), np.frombuffer(b.column("numbers")[k].as_buffer(), np.float32))
            else:
                yield *(ids[ends[k] : ends[k + 1]] for ends, ids in lists), labels[k].as_py(), weights[k].as_py()


def _mean(shares: dict[int, float], kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A block of all workers, averaged by their shares of the rows, in the order of those."""

    def mean(f: pd.DataFrame) -> pd.DataFrame:
        numbers = {w: np.frombuffer(x, np.float32) for w, x in zip(f["worker"], f["numbers"])}
        total = functools.reduce(np.add, [numbers[w].astype(float) * share for w, share in shares.items()])
        return pd.DataFrame({"bag": f["bag"].iloc[:1], "at": f["at"].iloc[:1], "numbers": [total.astype(kind).tobytes()]})

    return mean


def classify(rows: DataFrame, model: Classifier | Trained, types: list[str], name: str) -> DataFrame:
    """classifier, title, type_name, value: logits of every row (title, words, entities) and type. The embeddings are stored as
    tables that ids are joined with (`pooling`); titles are distinct."""
    stored, tables = isinstance(model, Trained), {}
    top = model.layers() if stored else model
    for k, _ in top.bags:
        if stored:
            table = pooling.from_blocks(model.blocks.where(F.col("bag") == k), top.dim, top.p[f"d{k}"] if top.attention else None)
        else:
            table = pooling.stored(rows.sparkSession, model.p[f"e{k}"], model.p[f"a{k}"] @ model.p[f"d{k}"] if model.attention else None)
        tables[("words", "entities")[k]] = table
    return pooling.logits(rows, tables, top.dim, [top.p[n] for n in ("w1", "b1", "w2", "b2")], types, name)


def accuracy(rows: DataFrame, model: Classifier, types: list[str]) -> DataFrame:
    """accuracy over rows (title, words, entities, label): the share whose largest logit, the last name of equals, is right."""
    best = classify(rows, model, types, "").groupBy("title").agg(F.max(F.struct("value", "type_name"))["type_name"].alias("best"))
    names = F.array(*[F.lit(t) for t in types])
    return rows.join(best, "title").agg(F.avg((F.array_position(names, F.col("best")) - 1 == F.col("label")).cast("double")).alias("accuracy"))


def search_classifier(rows: DataFrame, shape: dict, space: dict[str, list] | None = None, evals: int = 100, epochs: int = 1, batch: int = 100, seed: int = 0) -> dict:
    """Random search over a classifier's options: the ones with the least loss on dev rows, with loss and accuracy there. rows:
    title, words, entities, label, weight, split. A trial is a task; the rows, labelled ones only, go along as one table."""
    space = space or CLASSIFIER_SPACE
    rng = np.random.default_rng(seed)
    trials = [{n: v[int(rng.integers(len(v)))] for n, v in space.items()} for _ in range(evals)]
    data = _bounded(rows).toPandas().sort_values("title")
    train, dev = data[data["split"] == "train"], data[data["split"] == "dev"]

    def run(k: int) -> tuple[float, float]:
        model = Classifier(**{**shape, **trials[k]})
        history = model.fit(train["words"].tolist(), train["entities"].tolist(), train["label"].tolist(), train["weight"].tolist(), (dev["words"].tolist(), dev["entities"].tolist(), dev["label"].tolist()), epochs, batch)
        return min(h["val_loss"] for h in history), max(h["val_acc"] for h in history)

    found = _tried(rows.sparkSession, len(trials), run)
    best = int(np.argmin([x[0] for x in found]))
    return {**trials[best], "val_loss": found[best][0], "val_acc": found[best][1]}


class Trees:
    """Gradient boosted regression trees on binned features; binary uses the logistic loss."""

    def __init__(self, trees: int = 1000, rate: float = 0.01, depth: int = 3, min_split: int = 30, subsample: float = 1.0, max_features: float = 1.0, binary: bool = False, bins: int = 64, seed: int = 0) -> None:
        self.trees, self.rate, self.depth, self.min_split, self.subsample, self.max_features, self.binary, self.bins, self.seed = trees, rate, depth, min_split, subsample, max_features, binary, bins, seed

    def _columns(self, n: int) -> int:
        """How many of n features a tree may use: max_features is a share up to 1, else a number."""
        return max(1, int(n * self.max_features)) if self.max_features <= 1 else min(n, int(self.max_features))

    def options(self) -> dict:
        return {k: getattr(self, k) for k in ("trees", "rate", "depth", "min_split", "subsample", "max_features", "binary", "bins", "seed")}

    def fit(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> Trees:
        """n: how often each row is there, once if not given. A share of counted rows is drawn without replacement, as counts."""
        rng = np.random.default_rng(self.seed)
        ranks = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, ranks) if n is None else _quantiles(c, n, ranks)) for c in x.T]
        b = self._binned(x)
        mean = float(y.mean()) if n is None else float(np.average(y, weights=n))
        mean = float(np.clip(mean, 1e-6, 1 - 1e-6)) if self.binary else mean
        self.start = float(np.log(mean / (1 - mean))) if self.binary else mean
        score, self.forest = np.full(len(y), self.start), []
        every = np.ones(len(y), np.int64) if n is None else n
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score)) if self.binary else score
            g, h = y - p, p * (1 - p) if self.binary else np.ones(len(y))
            use, times = np.arange(len(y)), every
            if self.subsample < 1:
                size = max(1, int(every.sum() * self.subsample))
                if n is None:
                    use = np.sort(rng.choice(len(y), size, replace=False))
                else:
                    times = rng.multivariate_hypergeometric(n, size, method="marginals")
                    use = np.flatnonzero(times)
            columns = np.sort(rng.choice(x.shape[1], self._columns(x.shape[1]), replace=False))
            tree = self._grow(b, g * times, h * times, times, use, columns, self.depth)
            self.forest.append(tree)
            score += self.rate * self._walk(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, b, g, h, times, rows, columns, depth):
        value = g[rows].sum() / max(h[rows].sum(), 1e-9)
        if not depth or times[rows].sum() < self.min_split:
            return float(value)
        best = None
        total, count = g[rows].sum(), times[rows].sum()
        for c in columns:
            bins = b[rows, c]
            n, s = np.bincount(bins, weights=times[rows], minlength=self.bins), np.bincount(bins, weights=g[rows], minlength=self.bins)
            n, s = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
            ok = (n > 0) & (n < count)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(count - n, 1), -np.inf)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0] + 1e-12:
                    best = (gain[k], c, k)
        if best is None or best[0] <= total**2 / count + 1e-12:
            return float(value)
        left = b[rows, best[1]] <= best[2]
        return int(best[1]), int(best[2]), self._grow(b, g, h, times, rows[left], columns, depth - 1), self._grow(b, g, h, times, rows[~left], columns, depth - 1)

    def _walk(self, tree, b) -> np.ndarray:
        if not isinstance(tree, (tuple, list)):
            return np.full(len(b), tree)
        left = b[:, tree[0]] <= tree[1]
        out = np.empty(len(b))
        out[left], out[~left] = self._walk(tree[2], b[left]), self._walk(tree[3], b[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.start)
        for t in self.forest:
            out += self.rate * self._walk(t, b)
        return 1 / (1 + np.exp(-out)) if self.binary else out


def _vectors(f: pd.DataFrame, names: list[str]) -> np.ndarray:
    return f[names].fillna(0.0).to_numpy(dtype=float)


def _quantiles(values: np.ndarray, n: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """numpy's quantiles of values that are there n times each."""
    order = np.argsort(values, kind="stable")
    ends, at = np.cumsum(n[order]), (n.sum() - 1) * ranks
    low = np.floor(at).astype(np.int64)
    a, b = (values[order][np.searchsorted(ends, np.minimum(k, ends[-1] - 1), side="right")] for k in (low, low + 1))
    t = at - low
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


def _bounded(rows: DataFrame) -> DataFrame:
    """rows, if one machine may hold them."""
    if rows.count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} labelled rows; see fit_large")
    return rows


def _counted(rows: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """keys, label, features, n: rows that are alike for trees as one, with their number. A task may hold them as long as no more
    than MOST_ROWS differ, however many rows there are."""
    value = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features]
    return _bounded(saved(rows.select(*keys, "label", *value).groupBy(*keys, "label", *features).agg(F.count(F.lit(1)).alias("n")), "counted"))


class Scorer:
    """A model of features by name: boosted trees (ours or MLlib's), or a linear one."""

    def __init__(self, features: list[str], binary: bool, trees: Trees | None = None, linear: list[float] | None = None) -> None:
        self.features, self.binary, self.trees, self.linear = features, binary, trees, linear

    def dumps(self) -> str:
        t = self.trees
        stored = None if t is None else {"options": t.options(), "edges": [e.tolist() for e in t.edges], "start": t.start, "forest": t.forest}
        return json.dumps({"features": self.features, "binary": self.binary, "linear": self.linear, "trees": stored})

    @classmethod
    def loads(cls, text: str) -> Scorer:
        d = json.loads(text)
        trees = None
        if d["trees"]:
            trees = Trees(**d["trees"]["options"])
            trees.edges, trees.start, trees.forest = [np.array(e) for e in d["trees"]["edges"]], d["trees"]["start"], d["trees"]["forest"]
        return cls(d["features"], d["binary"], trees, d["linear"])

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with prediction. Features that rows lack are 0, others are not read. A linear model is an expression; trees go
        over batches."""
        there = set(rows.columns)
        value = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in there else F.lit(0.0) for f in self.features}
        if self.trees is None:
            total = F.lit(self.linear[-1])
            for w, f in zip(self.linear, self.features):
                total = total + F.lit(w) * value[f]
            return rows.withColumn("prediction", 1 / (1 + F.exp(-total)) if self.binary else total)
        sent = rows.sparkSession.sparkContext.broadcast(self.dumps())

        @F.pandas_udf("double")
        def predicted(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = Scorer.loads(sent.value).trees
            for x in frames:
                yield pd.Series(trees.predict(np.array(x.tolist(), dtype=float).reshape(len(x), -1)))

        return rows.withColumn("prediction", predicted(F.array(*value.values())))


def fit_scorer(rows: DataFrame, features: list[str], **options) -> Scorer:
    """Trees from the labelled rows (title, type_name, label, features), which one task must hold, or their different ones with
    counts where they are many."""
    features = sorted(features)
    rows = saved(rows.select("title", "type_name", "label", *features), "labelled")
    many = rows.count() > MOST_ROWS

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values([*features, "label"] if many else ["title", "type_name"])
        trees = Trees(**options).fit(_vectors(f, features), f["label"].to_numpy(), f["n"].to_numpy() if many else None)
        yield pd.DataFrame({"model": [Scorer(features, bool(options.get("binary")), trees).dumps()]})

    some = (_counted(rows, features) if many else rows).coalesce(1)
    return Scorer.loads(some.mapInPandas(fit, "model string").first()["model"])


def fit_large(rows: DataFrame, features: list[str], trees: int = 1000, rate: float = 0.01, depth: int = 3, subsample: float = 1.0, binary: bool = False):
    """An MLlib pipeline model from rows of any number (label, features); its transform gives `prediction`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    kind = GBTClassifier if binary else GBTRegressor
    boosted = kind(featuresCol="assembled", labelCol="label", maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, seed=0)
    return Pipeline(stages=[VectorAssembler(inputCols=sorted(features), outputCol="assembled"), boosted]).fit(rows.na.fill(0.0, features))


def save_model(spark: SparkSession, model: Classifier | Scorer, path: str, **about) -> None:
    """A model and what belongs to it (JSON values), as a table of one row."""
    data = model.dumps()
    row = (type(model).__name__, data if isinstance(data, bytes) else data.encode(), json.dumps(about, sort_keys=True))
    table = pa.table({n: pa.array([v]) for n, v in zip(("kind", "model", "about"), row)})  # read by the JVM: no Python worker starts
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[Classifier | Scorer, dict]:
    r = spark.read.parquet(path).first()
    model = Classifier.loads(bytes(r["model"])) if r["kind"] == "Classifier" else Scorer.loads(bytes(r["model"]).decode())
    return model, json.loads(r["about"])


def cross_validated(rows: DataFrame, features: list[str], k: int = 10, **options) -> DataFrame:
    """title, type_name, fold, label, prediction of rows (title, type_name, fold, label, features): a task trains on the other
    folds of its own. The rows are labelled ones, which are counted first: of more than a task may hold, equal ones become one
    with their number (`_cross_validated_counted`); if too many differ, that raises an error, as in `fit_scorer`, since the trees
    of `cross_validated_large` don't have all of the options."""
    rows = saved(rows.select("title", "type_name", "fold", "label", *features), "labelled")
    if rows.count() > MOST_ROWS:
        return _cross_validated_counted(rows, features, k, **options)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["title", "type_name"])
        test = f["fold"] == key[0]
        model = Trees(**options).fit(_vectors(f[~test], features), f.loc[~test, "label"].to_numpy())
        out = f.loc[test, ["title", "type_name", "fold", "label"]].copy()
        out["prediction"] = model.predict(_vectors(f[test], features)) if len(out) else []
        return out

    return _tasks(rows, k).groupBy("task").applyInPandas(run, PREDICTIONS)


def _tasks(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("task", F.explode(F.sequence(F.lit(1), F.lit(k))))


def _cross_validated_counted(rows: DataFrame, features: list[str], k: int, **options) -> DataFrame:
    """The same trees from counts of equal rows. Each task's model then goes to all rows of its fold, where they are."""

    def fit(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f[f["fold"] != key[0]].sort_values([*features, "label", "fold"])
        trees = Trees(**options).fit(_vectors(f, features), f["label"].to_numpy(), f["n"].to_numpy())
        return pd.DataFrame({"fold": [key[0]], "model": [Scorer(features, bool(options.get("binary")), trees).dumps()]})

    models = _tasks(_counted(rows, features, "fold"), k).groupBy("task").applyInPandas(fit, "fold int, model string").collect()
    sent = rows.sparkSession.sparkContext.broadcast({r["fold"]: r["model"] for r in models})

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = {fold: Scorer.loads(m).trees for fold, m in sent.value.items()}
        for f in frames:
            for fold, some in f.groupby("fold"):
                yield some[["title", "type_name", "fold", "label"]].assign(prediction=trees[fold].predict(_vectors(some, features)))

    return rows.where(F.col("fold").between(1, k)).mapInPandas(predict, PREDICTIONS)


def cross_validated_large(rows: DataFrame, features: list[str], k: int = 10, trees: int = 1000, rate: float = 0.01, depth: int = 3, subsample: float = 1.0, binary: bool = False) -> DataFrame:
    """The same for any number of rows, with MLlib's trees and their options. A binary prediction is the probability of 1."""
    from pyspark.ml.functions import vector_to_array

    parts = []
    for f in range(1, k + 1):
        found = fit_large(rows.where(F.col("fold") != f), features, trees, rate, depth, subsample, binary).transform(rows.where(F.col("fold") == f).na.fill(0.0, features))
        prediction = vector_to_array("probability")[1] if binary else F.col("prediction")
        parts.append(found.select("title", "type_name", F.col("fold").cast("int").alias("fold"), "label", prediction.alias("prediction")))
    return functools.reduce(DataFrame.unionByName, parts)


def _cv_score(f: pd.DataFrame, features: list[str], options: dict) -> float:
    """The mean over folds: accuracy if binary, else the negated absolute error."""
    out = []
    for fold in sorted(f["fold"].unique()):
        test = f["fold"] == fold
        p = Trees(**options).fit(_vectors(f[~test], features), f.loc[~test, "label"].to_numpy()).predict(_vectors(f[test], features))
        y = f.loc[test, "label"].to_numpy()
        out.append(((p >= 0.5) == y).mean() if options.get("binary") else -np.abs(p - y).mean())
    return float(np.mean(out))


def _tried(spark: SparkSession, n: int, run) -> list:
    """run(k) for each trial, each in a task of its own."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"k": f["k"], "found": [json.dumps(run(k)) for k in f["k"].tolist()]})

    frame = spark.createDataFrame([(k,) for k in range(n)], "k int").repartition(max(1, min(n, 64)), "k")
    return [json.loads(r["found"]) for r in frame.mapInPandas(work, "k int, found string").orderBy("k").collect()]


def _scored(rows: DataFrame, trials: list[tuple[list[str], dict]]) -> list[float]:
    """The score of each trial (features, options); rows (title, type_name, fold, label, features) are labelled ones."""
    data = _bounded(rows).toPandas().sort_values(["title", "type_name"])
    return _tried(rows.sparkSession, len(trials), lambda k: _cv_score(data, *trials[k]))


def first_best(scores: list[float]) -> int:
    """The place of the largest score, the first of equals."""
    return int(np.argmax(scores))


def last_best(history: list[dict]) -> dict:
    """The entry with the largest score, the last of equals."""
    return max(reversed(history), key=lambda h: h["score"])


def select_features(rows: DataFrame, features: list[str], k: int | None = None, scored=_scored, **options) -> dict:
    """Greedy forward selection: each step adds the feature with the best score (the first of equals); the best step's list, the
    last of equals, is returned with its score."""
    chosen, history = [], []
    while len(chosen) < min(k or len(features), len(features)):
        left = [f for f in features if f not in chosen]
        found = scored(rows, [([*chosen, f], options) for f in left])
        best = first_best(found)
        chosen = [*chosen, left[best]]
        history.append({"features": chosen, "score": found[best]})
    return last_best(history)


def search_hyper_params(rows: DataFrame, features: list[str], space: dict[str, list], evals: int = 100, seed: int = 0, scored=_scored, **fixed) -> dict:
    """Random search over the grid `space`; the best options, the first of equals, with their score."""
    rng = np.random.default_rng(seed)
    trials = [{n: v[int(rng.integers(len(v)))] for n, v in space.items()} for _ in range(evals)]
    found = scored(rows, [(features, {**fixed, **t}) for t in trials])
    return {**trials[first_best(found)], "score": max(found)}
