"""Toxicity by composed finite-state transducers: a learned lexicon, and a grammar of insults, threats, targets, negation and
reported speech over clauses."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved, spread
from .words import release

# Words of the grammar's classes, in English, French, German and Spanish.
#: Stems of threats and reports, each group with the endings that its words take; none is "-".
THREAT_STEMS = (("kill murder destroy punch", "- s es ed ing"), ("hurt beat", "- s en ing"), ("strangl", "e es ed ing"), ("tu frapp", "er é ée és erai eras era ez ons ant"), ("töt", "en e et est ete eten"), ("umbring schlag umgebracht geschlagen getötet", "- en e t"), ("schläg", "t st"), ("mat golpe", "ar aré arás ará ado ada ando aron"))
REPORT_STEMS = (("claim report call", "- s ed ing"), ("quot", "e es ed ing"), ("say tell writ wrot", "- s e es ing"), ("said told dit disait écrit écrivait appelé affirmé sagt sagte schrieb schreibt nannte behauptet behauptete dijo dice escribió escribe llamó afirmó", "-"))
TARGETS = "you your u yourself he she they them him her tu te toi vous votre ton ta du dich dir euch ihr dein deine tú ti usted ustedes vosotros".split()
#: And every word that ends in n't.
NEGATIONS = "not never cannot no nobody pas jamais ne non nicht kein keine nie nunca jamás ningún".split()
#: Insult stems used only where no labels are there to learn from; a word that ends in $ must match whole.
DEFAULT_STEMS = "idiot$ moron$ scum$ loser$ worthless$ stupid$ pathetic$".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
SYMBOLS = 7
#: What the grammar emits, one of these for each insult and for each threat that has a target.
KINDS = ("plain", "aimed", "negated", "reported", "threat", "negated threat", "reported threat")
SCOPE = 3  # words that a negation reaches over

SCORES = "doc_id long, held_out boolean, score double, predicted int"


def _forms(groups) -> list[str]:
    """Every stem of a group, followed by every ending of it."""
    return [stem + (ending if ending != "-" else "") for stems, endings in groups for stem in stems.split() for ending in endings.split()]


THREATS, REPORTS = _forms(THREAT_STEMS), _forms(REPORT_STEMS)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


def _plain(text: str | None) -> str:
    """Lower case, with the straight apostrophe for the curved one; places stay, but for letters whose lower case is longer."""
    return (text or "").lower().replace("\u2019", "'")


class Transducer:
    """A deterministic transducer over symbols: step(state, symbol) -> (state, output); one that others follow gives a symbol."""

    def __init__(self, start, step) -> None:
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: this one's outputs are the other's inputs."""

        def step(state, symbol):
            a, between = self.step(state[0], symbol)
            b, out = other.step(state[1], between)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols: int) -> list[list[tuple[int, object]]]:
        """Every state that can be reached, numbered from the start: [state][symbol] -> (state, output)."""
        states, rows = {self.start: 0}, []
        queue = [self.start]
        for state in queue:
            row = []
            for symbol in range(symbols):
                to, out = self.step(state, symbol)
                if to not in states:
                    states[to] = len(states)
                    queue.append(to)
                row.append((states[to], out))
            rows.append(row)
        return rows


def grammar() -> list[list[tuple[int, object]]]:
    """Reported speech, then negation, then target, composed. Input: word classes, and END after a clause's last word. Output:
    a tuple of (kind, whether it is of the word at hand rather than of the one that waits).

    Reported speech marks what follows a report in its clause; a negation marks the SCOPE words after it, and counts before a
    report. Marks travel with the symbol: class + SYMBOLS * (1: reported, 2: negated). An insult or threat without a target
    before it waits for one; only one waits, the next insult or threat and the clause's end let it go. So every insult gives
    one output: aimed if a target is in its clause by then, negated or reported if marked, else plain. A threat without a
    target gives none.
    """
    reported = Transducer(0, lambda s, x: (1 if x == REPORT else s, x + SYMBOLS * (s if x in (INSULT, THREAT) else 0)))

    def deny(left, x):
        now = SCOPE if x % SYMBOLS == NEGATION else max(0, left - 1)
        return now, x + 2 * SYMBOLS * (left > 0 and x % SYMBOLS in (INSULT, THREAT))

    def aim(state, x):
        seen, waiting = state  # waiting: -1, or the kind that a target would make of it
        kind, marks = x % SYMBOLS, x // SYMBOLS
        let_go = ((0, False),) if waiting == 1 else ()  # an insult that no target came for; threats go silently
        if kind == TARGET:
            return (1, -1), ((waiting, False),) if waiting >= 0 else ()
        if kind == THREAT:
            as_threat = 5 if marks & 2 else 6 if marks else 4
            return ((seen, -1), ((as_threat, True),)) if seen else ((seen, as_threat), let_go)
        if kind == INSULT:
            if marks or seen:
                return (seen, waiting), ((2 if marks & 2 else 3 if marks else 1, True),)
            return (seen, 1), let_go
        return ((seen, -1), let_go) if kind == END else (state, ())

    return reported.then(Transducer(0, deny)).then(Transducer((0, -1), aim)).table(SYMBOLS)


class Model(NamedTuple):
    stems: dict[str, float]  # with their log odds
    weights: list[float]  # of `features`, and a constant at the end


class Matcher:
    """Counts matched clauses of a text. A search for stems and threats comes first; only their clauses are read by the grammar."""

    def __init__(self, stems: dict[str, float]) -> None:
        import ahocorasick

        self.stems, self.table = stems, grammar()
        self.classes = {w: c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}
        self.search = ahocorasick.Automaton()
        for s in {s.rstrip("$") for s in stems} | set(THREATS):
            self.search.add_word(s, len(s))
        self.search.make_automaton()
        self.longest = max(map(len, stems), default=0)

    def weight(self, word: str) -> float:
        best = self.stems.get(word + "$", 0.0)
        for n in range(1, min(len(word), self.longest) + 1):
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def features(self, text: str | None) -> list[float]:
        """For each kind log(1 + count) and whether there is one; the largest clause score; matches a thousand words. A clause,
        however long, is read word by word from end to end, once."""
        text = _plain(text)
        counts, top, done, ends = [0] * len(KINDS), 0.0, 0, None
        for end, n in self.search.iter(text):
            at = end - n + 1
            if at < done or at and (text[at - 1].isalpha() or text[at - 1] == "'"):
                continue
            if ends is None:
                ends = self.ends(text)
            k = bisect_left(ends, at)
            lo, done = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(text)
            score = 0.0
            for kind, strength in self.clause(text, lo, done):
                counts[kind] += 1
                score += strength or 1.0
            top = max(top, score)
        words = max(1, len(text) // 6)
        return [*(math.log1p(c) for c in counts), *(float(c > 0) for c in counts), math.log1p(top), min(5.0, 1000 * sum(counts) / words / 10)]

    def ends(self, text: str) -> list[int]:
        """Where clauses end. A colon after a report doesn't end its clause: what follows is reported."""
        out, opened, at = [], False, 0
        for m in _CLAUSE_END.finditer(text):
            if m[0] == ":":
                opened = opened or any(self.classes.get(w) == REPORT for w in _WORD.findall(text, at, m.start()))
                at = m.end()
                if opened:
                    continue
            out.append(m.start())
            opened, at = False, m.end()
        return out

    def clause(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, float]]:
        """The outputs of the clause text[lo:hi], in lower case, each with its word's strength."""
        state, held = 0, 0.0
        for m in _WORD.finditer(text, lo, hi):
            word = m[0]
            symbol, strength = NEGATION if word.endswith("n't") else self.classes.get(word, OTHER), 0.0
            if symbol in (OTHER, THREAT):
                strength = self.weight(word)
                symbol = INSULT if strength else symbol
            state, out = self.table[state][symbol]
            for kind, now in out:
                yield kind, strength if now else held
            if symbol in (INSULT, THREAT):
                held = strength
        for kind, _ in self.table[state][END][1]:
            yield kind, held


def _closed(count: Counter, positives: int, share: float) -> dict[str, int]:
    """Prefixes that enough documents have, without those that nearly all their documents continue by the same letter."""
    enough = {p: n for p, n in count.items() if n >= max(4, share * positives)}
    return {p: n for p, n in enough.items() if not any(len(q) == len(p) + 1 and q.startswith(p) and m >= 0.95 * n for q, m in enough.items())}


def _prefixes(text: str, longest: int) -> set[str]:
    """Of the text's words in lower case, all prefixes of 3 to `longest` letters, and the words themselves with $ at their end."""
    words = {w for w in _WORD.findall(_plain(text)) if len(w) >= 3}
    return {w[:n] for w in words for n in range(3, min(longest, len(w)) + 1)} | {w + "$" for w in words}


def fit(labelled: DataFrame, most_rows: int = 5000, share: float = 0.02, lift: float = 2.5, longest: int = 8) -> Model:
    """A model from labelled (doc_id, text, toxic).

    Learned from the most_rows rows with the smallest hash of doc_id (a bounded sample). Copies count once: of rows with the
    same smallest hash of three words only one is kept. The lexicon is the closed prefixes (of 3 to `longest` letters) and
    whole words that at least `share` of the toxic rows have (four rows at least), that are e**lift times as frequent there
    (less one standard error of that), and that no longer prefix beats with most of the same rows; weights of the grammar's counts are a ridge logistic
    regression. Null texts and labels are left out; rows of one id and several texts count each; without both labels the
    default stems and weights are used. Executors count words; the driver gets the candidates, which `share` and the sample
    bound, and most_rows rows of numbers. Column names besides the three don't matter.
    """
    rows = labelled.where("text IS NOT NULL AND toxic IS NOT NULL").select(labelled["doc_id"], labelled["text"], labelled["toxic"])
    rows = rows.orderBy(F.xxhash64(F.col("doc_id")), "doc_id", "text").limit(most_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for f in batches:
            keys = []
            for t in f.column("text").to_pylist():
                w = t.split()
                keys.append(min((xxhash.xxh64_intdigest(" ".join(w[k : k + 3])) >> 1 for k in range(max(1, len(w) - 2))), default=0))
            yield pa.RecordBatch.from_arrays([*f.columns, pa.array(keys, pa.int64())], [*f.schema.names, "near"])

    sample = saved(rows.withColumn("toxic", F.col("toxic").cast("int")).repartition(32, "doc_id").mapInArrow(hashed, "doc_id long, text string, toxic int, near long"), "labelled")
    sample = sample.join(sample.groupBy("near", "toxic").agg(F.min("doc_id").alias("doc_id")), ["near", "toxic", "doc_id"], "left_semi")

    def count(kept: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for f in batches:
                for t in f.column("text").to_pylist():
                    found = _prefixes(t, longest)
                    total.update(found if kept is None else found & kept)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["stem", "n"])

        return run

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
    if not positives or not negatives:
        return Model({s: 3.0 for s in DEFAULT_STEMS}, [0.0] * 7 + [4.0, 5.0, 1.0, 1.0, 5.0, 2.0, 2.0, 0.0, 0.0, -2.0])
    toxic, clean = (sample.where(F.col("toxic") == k).select("text") for k in (1, 0))
    many = toxic.mapInArrow(count(None), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4, share * positives))
    candidates = _closed(Counter({r["stem"]: r["n"] for r in many.collect()}), positives, share)
    there = clean.mapInArrow(count(frozenset(candidates)), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).collect()
    against = {r["stem"]: r["n"] for r in there}
    odds = {s: math.log((n + 0.5) / (positives + 1)) - math.log((against.get(s, 0) + 0.5) / (negatives + 1)) for s, n in candidates.items()}
    stems: dict[str, float] = {}
    error = {s: math.sqrt(1 / (n + 0.5) + 1 / (against.get(s, 0) + 0.5)) for s, n in candidates.items()}
    strong = sorted((s for s, x in odds.items() if x - error[s] >= lift), key=lambda s: (len(s), s))
    for s in strong:
        purer = any(len(t) > len(s) and t.startswith(s) and candidates[t] >= 0.6 * candidates[s] and odds[t] > odds[s] + 0.5 for t in strong)
        if not purer and not any(s.startswith(p) for p in stems if not p.endswith("$")):
            stems[s] = odds[s]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(stems)
        for f in batches:
            x = [matcher.features(t) for t in f.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), f.column("toxic")], ["x", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").collect()
    return Model(stems, _logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> list[float]:
    """Newton's method; both labels weigh the same in sum, the constant isn't held down."""
    x = np.hstack([x, np.ones((len(x), 1))])
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    hold = np.full(x.shape[1], ridge / 100)
    hold[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(hold), x.T @ (each * (y - p)) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score(text, model: Model):
    """The score, from 0 to 1, of each whole text in a column; a null or empty text has the score of no match at all.

    Rows are scored alone, by their text only; repeated rows get the same score, an empty table none. A very long text is read
    like any other: its clauses are streamed through the grammar, whatever their length.
    """

    @F.pandas_udf("double")
    def scored(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher, w = Matcher(model.stems), np.array(model.weights)
        for texts in frames:
            x = np.array([[*matcher.features(t), 1.0] for t in texts]).reshape(-1, len(w))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))
        release()

    return scored(text)


def held_out(doc_id, parts: int = 5):
    """Whether crc32 of the id as text leaves remainder 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def model_for(spark, docs: DataFrame, sf_dir: str, most_rows: int = 5000) -> Model:
    """A model from the documents that aren't held out. The sample is drawn from ids and labels; only its ids, at most
    most_rows, are broadcast to fetch the texts, which are never shuffled."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where("toxic IS NOT NULL")
    ids = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id").join(labels, "doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64(F.col("doc_id")), "doc_id", "toxic").limit(most_rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), most_rows)


def query(spark, sf_dir: str) -> DataFrame:
    """A null doc_id meets no label, so its row is scored, but never learned from; it is held out or not as an empty id is."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model_for(spark, docs, sf_dir)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
