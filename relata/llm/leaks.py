"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved, spread

# Fixed value: a word's characters, A-Z among them since words are lowered later. (Java's negated form, with the ranges in
# between, takes seven times as long.)
_IN = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORD, _BETWEEN = f"[{_IN}]+", f"(?<![{_IN}])(?=[{_IN}])"
#: Windows that are sent to all tasks at once, at some 100 bytes each: a window's hash, its 256-bit digest, its number and its
#: length, whatever its words. A larger set is sent in parts, with a scan of the documents for each.
MOST_SENT = 500_000


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    """The words of a text as they are written; null has none. They are lowered one by one where they are hashed or compared,
    since few of them need more than ASCII's rule."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _with_runs(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (words) with run_<length>: the hash of the run of so many words at each place; those beyond the end mean nothing.

    Hashes of 2, 4, 8 words are made of two halves each, and a length's of those that add up to it. Each array is a column of
    its own that is used twice, so that none is made again for every element of the next.
    """
    at = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    both = lambda a, b, k: F.zip_with(a, at(b, k), lambda x, y: F.xxhash64(x, y))
    rows, powers = rows.withColumn("of_1", F.transform("words", lambda w: F.xxhash64(lowered(w)))), {1: "of_1"}
    for k in range(1, max(lengths).bit_length()):
        powers[2**k] = f"of_{2**k}"
        rows = rows.withColumn(f"of_{2**k}", both(powers[2 ** (k - 1)], powers[2 ** (k - 1)], 2 ** (k - 1)))
    for n in lengths:
        first, *rest = [p for p in sorted(powers, reverse=True) if n & p]
        run, done = F.col(powers[first]), first
        for k, p in enumerate(rest):
            rows = rows.withColumn(f"sum_{n}_{k}", both(run, powers[p], done))
            run, done = F.col(f"sum_{n}_{k}"), done + p
        rows = rows.withColumn(f"run_{n}", run)
    return rows


def digest(words: Column) -> Column:
    return F.sha2(lowered(F.array_join(words, " ")), 256)


def windows(benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(distinct windows: window, hash, digest, length; which items have them: window, item_id) of benchmark (item_id, text).
    A window is a run of n words of an item, or all words of a shorter one."""
    items = saved(benchmark.select(benchmark["item_id"].alias("item_id"), words(benchmark["text"]).alias("words")).where("size(words) > 0"), "items")
    lengths = [r["length"] for r in items.select(F.least(F.size("words"), F.lit(n)).alias("length")).distinct().collect()]  # n of them at most
    each = [items.select("item_id", F.lit(0).cast("long").alias("hash"), F.lit("").alias("digest"), F.lit(0).alias("length")).limit(0)]
    for k in lengths:
        some = _with_runs(items.where(f"size(words) {'=' if k < n else '>='} {k}"), [k]).select("item_id", "words", F.posexplode(f"run_{k}").alias("pos", "hash")).where(f"pos + {k} <= size(words)")
        each.append(some.select("item_id", "hash", digest(F.slice("words", F.col("pos") + 1, k)).alias("digest"), F.lit(k).alias("length")))
    every = saved(reduce(DataFrame.unionByName, each).distinct(), "windows")
    numbered = saved(every.groupBy("digest").agg(F.first("hash").alias("hash"), F.first("length").alias("length")).withColumn("window", F.monotonically_increasing_id()), "window-numbers")
    return numbered, every.where("item_id IS NOT NULL").join(numbered.select("digest", "window"), "digest").select("window", "item_id")


def occurrences(docs: DataFrame, found: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, key, size, at, length, window of docs (doc_id, key, text), saved: a row with the number of words for each of
    docs, where `at` is null, and one for each place where a window occurs.

    A text's windows are hashed, looked up in the hash table of windows that each task has, and a hit counts if the 256-bit
    digest of its words is the window's, too. Neither texts nor words are shuffled: the rows that leave a task are hits, and one
    for each document. (Arrays are made in projections of their own, since only then does code generation join the explode
    with the lookup, and no row is copied for each of its words.)
    """
    lengths = [r["length"] for r in found.select("length").distinct().orderBy("length").collect()] or [n]  # n of them at most
    rows = _with_runs(docs.select("doc_id", "key", words(F.col("text")).alias("words")), lengths)
    keep, runs = ["doc_id", "key", "words"], [f"run_{k}" for k in lengths]
    rows = rows.select(*keep, *runs, F.posexplode_outer(runs[0]).alias("pos", "run")).withColumn("begins", F.col("pos").isNull() | (F.col("pos") == 0))
    if len(lengths) > 1:
        rows = rows.select(*keep, "pos", "begins", F.posexplode(F.array(*[F.get(r, "pos") for r in runs])).alias("which", "run")).withColumn("begins", F.col("begins") & (F.col("which") == 0))
    same = digest(F.slice("words", F.col("pos") + 1, F.col("length"))) == F.col("digest")

    def hits(some: DataFrame, first: bool) -> DataFrame:
        met = rows.join(F.broadcast(some), (F.col("run") == F.col("hash")) & same, "left").withColumn("begins", F.col("begins") & F.lit(first))
        at = F.when(F.col("window").isNotNull(), F.col("pos"))
        return met.where("window IS NOT NULL OR begins").select("doc_id", "key", F.size("words").alias("size"), at.alias("at"), "length", "window", "begins")

    parts = max(1, -(-found.count() // MOST_SENT))
    every = [hits(found if parts == 1 else found.where(F.pmod("hash", F.lit(parts)) == k), k == 0) for k in range(parts)]
    return saved(reduce(DataFrame.unionByName, every), "hits")


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: repeated rows have one key, rows of one id with other texts have others."""
    return docs.select(docs["doc_id"].alias("doc_id"), _key(docs["text"]).alias("key"), docs["text"].alias("text"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def spans(hits: DataFrame) -> DataFrame:
    """doc_id, key, size, copies (rows of docs), n_hit, kept: the number of words inside hits, and the runs of words (begin, end)
    outside of them; the last has no end. A document's hits are put in order by one task: as many rows as it has words at most,
    however many copies of its row there are."""
    each = hits.groupBy("doc_id", "key", "at").agg(F.max("length").alias("length"), F.max("size").alias("size"), F.sum(F.col("begins").cast("long")).alias("copies"))
    each = each.withColumn("end", F.col("at") + F.col("length"))
    each = each.withColumn("before", F.coalesce(F.max("end").over(Window.partitionBy("doc_id", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    covered = F.when(F.col("at").isNotNull(), F.greatest(F.lit(0), F.col("end") - F.greatest("at", "before"))).otherwise(0)
    gap = F.when(F.col("at") > F.col("before"), F.struct(F.col("before").alias("begin"), F.col("at").alias("end")))
    out = each.groupBy("doc_id", "key").agg(F.max("size").alias("size"), F.sum("copies").alias("copies"), F.sum(covered).cast("long").alias("n_hit"), F.sort_array(F.collect_list(gap)).alias("gaps"), F.max("end").alias("last"))
    tail = F.array(F.struct(F.coalesce("last", F.lit(0)).alias("begin"), F.lit(None).cast("int").alias("end")))
    return out.select("doc_id", "key", "size", "copies", "n_hit", F.concat("gaps", tail).alias("kept"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (their ids as strings, in order), contaminated per row of docs (doc_id, text).

    A word is hit inside any occurrence of a benchmark window; an item counts if one of its windows occurs. Windows that many
    items share are looked up once, and meet their items after a document's are made distinct.

    Null and wordless texts have no words, wordless items no windows. A null item_id marks words, but is no item. Repeated
    items count once; repeated rows of docs give equal rows; rows with one id and other texts, or with null ids, are judged
    alone. A very long text is one row's array of
    words and of their windows' hashes. An empty benchmark hits nothing; no documents give no rows. Column names besides
    doc_id, item_id and text don't matter.
    """
    found, items = windows(benchmark, n)
    hits = occurrences(_keyed(docs), found, n)
    which = hits.where("window IS NOT NULL").select("doc_id", "key", "window").distinct().join(items, "window")
    which = which.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = spans(hits).alias("h").join(which.alias("i"), _same("h", "i"), "left")
    listed = F.coalesce("i.items", F.array().cast("array<string>"))
    out = out.select("h.doc_id", F.col("h.size").cast("long").alias("n_words"), "h.n_hit", F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (F.col("h.n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("h.copies"))).alias("copy"))
    return out.drop("copy")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "spans") -> DataFrame:
    """docs without what the benchmark has: remove="documents" leaves out documents with a hit, "spans" the words that are hit,
    each with the characters up to the next word. Edge cases as in `contamination`; columns and other rows stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    found, _ = windows(benchmark, n)
    hit = spans(occurrences(_keyed(docs), found, n)).where("n_hit > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("doc_id"), _key(docs["text"]).alias("key"))
    if remove == "documents":
        return rows.alias("d").join(hit.alias("h"), _same("d", "h"), "left_anti").select("row.*")
    both = rows.alias("d").join(hit.alias("h"), _same("d", "h"), "left").select("d.row", "h.kept")
    text = F.col("row.text")
    cut = F.split(text, _BETWEEN, -1)  # what is before the first word, if anything; then each word with what follows
    both = both.select("row", "kept", F.when(F.col("kept").isNotNull(), cut).alias("cut"), F.when(text.rlike("^" + WORD), 0).otherwise(1).alias("lead"))
    size = lambda x: F.coalesce(x["end"], F.size("cut")) - x["begin"]
    left = F.flatten(F.transform("kept", lambda x: F.slice("cut", x["begin"] + F.col("lead") + 1, F.greatest(size(x), F.lit(0)))))
    clean = F.when(F.col("kept").isNull(), text).otherwise(F.array_join(F.concat(F.slice("cut", F.lit(1), F.col("lead")), left), ""))
    return both.select(*[(clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS v FROM i),
s AS (SELECT DISTINCT len(v) AS n FROM v),
p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, s),
h AS (SELECT p.doc_id, p.p, p.n, v.item_id FROM (SELECT doc_id, n, p, w[p:p + n - 1] AS x FROM p) p JOIN v ON v.v = p.x),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
