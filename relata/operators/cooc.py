"""Vocabularies and co-occurrence counts over sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import parts_of, saved
from .datasets import encoded_texts

#: Entities of a sentence that are paired in one row.
BLOCK = 256
#: Parts of an entity's windows that go to tasks of their own.
SPREAD = 8
_BEFORE = (Window.unboundedPreceding, -1)


def vocabulary(tokens: DataFrame, min_count: int = 5) -> DataFrame:
    """token, n, id (from 1, the most frequent first, then by code points) of tokens (token) that are frequent enough.

    An id is the number of tokens of larger counts, of those of its count with a smaller first letter pair, and its place among
    the others; no task sorts the whole vocabulary, only the counts that there are. They are saved first, as they are read twice.
    """
    counts = saved(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count), "token-counts").withColumn("pair", F.substring("token", 1, 2))
    cells = counts.groupBy("n", "pair").agg(F.count(F.lit(1)).alias("c"))
    levels = cells.groupBy("n").agg(F.sum("c").alias("c")).select("n", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(*_BEFORE)), F.lit(0)).alias("above"))
    cells = cells.select("n", "pair", F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("pair").rowsBetween(*_BEFORE)), F.lit(0)).alias("earlier")).join(levels, "n")
    place = F.row_number().over(Window.partitionBy("n", "pair").orderBy("token"))
    return counts.withColumn("place", place).join(cells, ["n", "pair"]).select("token", "n", (F.col("above") + F.col("earlier") + F.col("place")).cast("int").alias("id"))


def linked_entities(sentences: DataFrame) -> DataFrame:
    """entity: every entity that a link of the sentences (links) names, however rarely."""
    return sentences.select(F.explode("links.entity").alias("entity")).distinct()


def word_entity(sentences: DataFrame, window: int | None, vocab: DataFrame | None = None) -> DataFrame:
    """entity, word, n: words among the `window` tokens before or after a link, counted for every mention.

    sentences: words (tokens, without spaces), links (entity, before: number of tokens before it, after: that of the first token
    after it). No window or 0 takes all tokens of the sentence. Tokens outside the vocabulary still use up the window. The windows
    are cut out of the sentence's own array, so a link meets its window's tokens only.

    A task's memory is that of the pairs which it counts. So windows, as one string each, are dealt by entity to tasks whose number
    follows the input's size, and counted there; SPREAD parts of an entity, by where its windows were read, keep a frequent one from
    being one task's. Then only counts are dealt, by word, to be summed and to meet the vocabulary without a further shuffle.
    """
    every, parts = F.size("words"), parts_of(sentences)
    reach = F.lit(window) if window else every
    tasks = [] if parts is None else [max(sentences.sparkSession.sparkContext.defaultParallelism, parts)]

    def near(link):
        before = F.slice("words", F.greatest(link["before"] - reach, F.lit(0)) + 1, F.least(link["before"], reach))
        return F.struct(link["entity"].alias("entity"), F.concat(before, F.slice("words", link["after"] + 1, reach)).alias("words"))

    some = sentences.select(F.explode(F.transform("links", near)).alias("x")).where("size(x.words) > 0")
    some = some.select("x.entity", F.array_join("x.words", " ").alias("words"), (F.spark_partition_id() % SPREAD).alias("part"))
    pairs = some.repartition(*tasks, "entity", "part").select("entity", "part", F.explode(F.split("words", " ")).alias("word"))
    counts = pairs.groupBy("entity", "part", "word").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.repartition(*tasks, "word").groupBy("entity", "word").agg(F.sum("n").alias("n"))
    return sums if vocab is None else sums.join(vocab.select(F.col("token").alias("word")), "word", "left_semi").select("entity", "word", "n")


def entity_entity(sentences: DataFrame, block: int = BLOCK) -> DataFrame:
    """e1, e2, n: sentences (links) that name both, in both directions; a sentence counts a pair once.

    A sentence of more than `block` entities is cut into blocks of them, in order, and every two blocks (or one with itself) are
    a row of their own, dealt to all tasks; so its pairs are made by many, and no row has more than two blocks.
    """
    every = sentences.select(F.array_sort(F.array_distinct("links.entity")).alias("all")).where("size(all) > 1")
    one = every.where(F.size("all") <= block).select(F.explode("all").alias("e1"), "all")
    short = one.select("e1", F.explode(F.filter("all", lambda e: e > F.col("e1"))).alias("e2"))
    cut = every.where(F.size("all") > block).withColumn("last", F.expr(f"(size(all) - 1) div {block}"))
    two = cut.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).withColumn("j", F.explode(F.sequence("i", "last")))
    part = lambda k: F.slice("all", (F.col(k) * block + 1).cast("int"), block)
    long = two.select(part("i").alias("a"), part("j").alias("b"), F.xxhash64("all").alias("s"), "i", "j").repartition("s", "i", "j")
    long = long.withColumn("e1", F.explode("a")).select("e1", F.explode("b").alias("e2")).where("e1 < e2")
    half = short.union(long).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct("e1", "e2", "n"), F.struct(F.col("e2").alias("e1"), F.col("e1").alias("e2"), "n"))
    return half.select(F.explode(both).alias("x")).select("x.e1", "x.e2", "x.n")


def entity_ids(sentences: DataFrame, names: DataFrame) -> DataFrame:
    """sent_id, links (entity: an id of names) of sentences (sent_id, links), for `entity_entity`: pairs are counted as ids, and no
    count is joined with names. Entities without a name are left out."""
    ids = encoded_texts(sentences.select("sent_id", F.col("links.entity").alias("words")), names, 2147483647, pad=False)
    return ids.select("sent_id", F.transform("ids", lambda x: F.struct(x.alias("entity"))).alias("links"))
