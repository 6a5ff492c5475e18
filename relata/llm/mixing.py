"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved, spread

WORD = r"[^\x20\x09-\x0D]+"
_ROWS_BEFORE = (Window.unboundedPreceding, -1)


def _running(rows: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """rows with before_<name>: the sum of each column over the rows before, in `order`. Ranges of it are summed one by one, and
    the only sum over all has one row a range; so sources may be as many as hosts."""
    ranges = saved(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    each = ranges.groupBy("range").agg(*[F.sum(n).alias(n) for n in sums])
    whole, local = Window.orderBy("range").rowsBetween(*_ROWS_BEFORE), Window.partitionBy("range").orderBy(*order).rowsBetween(*_ROWS_BEFORE)
    each = each.select("range", *[F.coalesce(F.sum(n).over(whole), F.lit(0)).alias(f"{n}_whole") for n in sums])
    ranges = ranges.withColumns({f"{n}_local": F.coalesce(F.sum(n).over(local), F.lit(0)) for n in sums}).join(each, "range")
    return ranges.withColumns({f"before_{n}": F.col(f"{n}_whole") + F.col(f"{n}_local") for n in sums}).drop("range", *[f"{n}_{x}" for n in sums for x in ("whole", "local")])


def targets(totals: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row per source with its target.

    totals: source, source_size. Sources in code point order, null last, weigh `weights`, repeating. All targets make up
    share * the sum of sizes; none is above limit * its source's size, and what it leaves goes to the others by weight.
    That is least(limit * size, level * weight) at one common level: with the sources by limit * size / weight, the level is
    that of the first source which is not held by its own limit.
    """
    by_name, name = [F.col("source").asc_nulls_last()], F.struct(F.col("source").isNull().alias("last"), "source")
    t = _running(totals.withColumn("one", F.lit(1)), by_name, ["one"])
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("before_one", F.lit(len(weights))).cast("int") + 1))
    t = t.withColumn("most", F.lit(float(limit)) * F.col("source_size")).withColumn("bound", F.col("most") / F.col("weight"))
    t = _running(t.select("source", "source_size", "weight", "most", "bound"), [F.col("bound"), *by_name], ["most", "weight"])
    every = t.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("heavy"))
    t = t.crossJoin(F.broadcast(every))  # of one row
    t = t.withColumn("level", (F.lit(float(share)) * F.col("total") - F.col("before_most")) / (F.col("heavy") - F.col("before_weight")))
    level = t.agg(F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", name.alias("name"), "level"))).alias("found")).select(F.col("found.level").alias("common"))
    t = t.crossJoin(F.broadcast(level))  # of one row
    return t.select("source", "source_size", "weight", F.least("most", F.col("common") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: str = "", carry: bool = False) -> DataFrame:
    """Each document with the words that the mix takes of it: doc_id, size, source_size, target, taken.

    docs: doc_id, text, source; other columns may have any names. A document's key is md5(seed + doc_id). Its place among its
    source's documents is a sum over three levels: the key's first byte, its second byte, and the documents that share both,
    so that no task sorts or sums more of a source than its 65,536th part, however large the source. A source is taken
    floor(target / size) times whole, then in key order until its budget (its target, rounded) is met exactly; the document
    at the cut is taken in part.

    Null texts and texts without words have size 0 and taken 0. A null source is a source of its own; a null doc_id has the
    key of an empty one. Repeated ids stand side by side, the larger size last, then by the text's hash where rows are carried;
    so reruns agree. A very long text is a row like any other. An empty table gives none. carry: return row (a struct of docs'
    own columns), size and taken.
    """
    clean = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row") if carry else F.lit(0).alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (F.xxhash64(docs["text"]) if carry else F.lit(0).cast("long")).alias("tie"))
    rows = saved(clean, "sizes")
    rows = rows.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("a", F.substring("key", 1, 2)).withColumn("b", F.substring("key", 3, 2))

    cells = rows.groupBy("s", "a", "b").agg(F.sum("size").alias("n"), F.max("source").alias("source"))
    cells = cells.withColumn("in_a", F.coalesce(F.sum("n").over(Window.partitionBy("s", "a").orderBy("b").rowsBetween(*_ROWS_BEFORE)), F.lit(0)))
    parts = cells.groupBy("s", "a").agg(F.sum("n").alias("n"), F.max("source").alias("source"))
    totals = parts.groupBy("s").agg(F.sum("n").alias("source_size"), F.max("source").alias("source"))
    parts = parts.select("s", "a", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("a").rowsBetween(*_ROWS_BEFORE)), F.lit(0)).alias("before_a"))
    goal = targets(totals, weights, share, limit).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source", "weight")
    goal = goal.withColumn("budget", F.floor(F.col("target") + 0.5))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    cells = cells.join(parts, ["s", "a"]).join(goal, "s")
    cells = cells.select("s", "a", "b", "source_size", "target", "whole", (F.col("budget") - F.col("whole") * F.col("source_size") - F.col("before_a") - F.col("in_a")).alias("left"))

    local = Window.partitionBy("s", "a", "b").orderBy("key", "doc_id", "size", "tie").rowsBetween(*_ROWS_BEFORE)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(local), F.lit(0)))
    rows = rows.join(cells, ["s", "a", "b"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    rows = rows.withColumn("taken", F.col("whole") * F.col("size") + part)
    if carry:
        return rows.select("row", "size", "taken")
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: a document taken n times gives n rows, and a last one, cut to the words that are left, in part.

    The cut text has one space between words. Documents without words are taken never.
    """
    m = mix(docs, carry=True, **options)
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    m = m.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    words, text = F.col("taken") - (F.col("copy") - 1) * F.col("size"), F.col("row")["text"]
    cut = F.call_function("substring_index", F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), F.lit(" "), words.cast("int"))
    text = F.when(words < F.col("size"), cut).otherwise(text)
    return m.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM t),
b AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS bound, sum(source_size) OVER () AS total, sum(weight) OVER () AS heavy FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * total::DOUBLE - coalesce(sum(most) OVER o, 0)) / (heavy - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY bound, source ASC NULLS LAST) AS place
  FROM b WINDOW o AS (ORDER BY bound, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(most, (SELECT arg_min(level, place) FROM l WHERE level <= bound) * weight) AS target FROM l),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM g),
p AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
                                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT p.doc_id, p.size::BIGINT AS size, q.source_size, q.target,
       (CASE WHEN q.source_size > 0 THEN (q.budget // q.source_size) * p.size + greatest(0, least(p.size, q.budget % q.source_size - p.before)) ELSE 0 END)::BIGINT AS taken
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
"""
