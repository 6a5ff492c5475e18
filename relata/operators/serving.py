"""From stored tables to classifiers' datasets, cached logits, scorers' rows and scored requests."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import saved
from ..sources import tables as S
from . import cooc, datasets, entities, learning, scoring


def page_bags(pages: DataFrame, parts: DataFrame, in_links: bool = True, out_links: bool = True, abstract_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(title, words: all tokens of pages (title, paragraphs), in lower case; title, token: each title that they link, or that
    links them, once). The links of `in_link_parts` are read part by part."""
    words = pages.select("title", T.lowered(T.tokens(entities.page_text(F.col("paragraphs"), abstract_only))).alias("words"))
    chosen = pages.select("title", F.explode(entities.chosen(F.col("paragraphs"), abstract_only)).alias("p"))
    out = chosen.select("title", F.explode("p.wiki_links").alias("x")).select("title", F.col("x.title").alias("token"))
    into = entities.in_links(parts).select("title", F.col("x.title").alias("token")).join(pages.select("title"), "title", "left_semi")
    links = out.where(F.lit(out_links)).unionByName(into.where(F.lit(in_links)))
    return words, links.distinct()


def page_vocabularies(words: DataFrame, links: DataFrame, text_len: int = 5000, min_word_count: int = 5, min_entity_count: int = 5) -> tuple[DataFrame, DataFrame]:
    """(words by how often they are among the pages' first text_len tokens, entities by how many pages link them)."""
    return cooc.vocabulary(datasets.first_words(words, text_len), min_word_count), cooc.vocabulary(links.select("token"), min_entity_count)


def _two_bags(titles: DataFrame, words: DataFrame, links: DataFrame, text_len: int, entity_len: int) -> DataFrame:
    """title, words, entities (ids, padded once they have met) and their numbers, for every title; one without any has empty bags."""
    out = titles.select("title").distinct().join(words, "title", "left").join(links, "title", "left")
    for name, size in (("words", text_len), ("entities", entity_len)):
        ids = F.coalesce(name, F.array().cast("array<int>"))
        out = out.withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0))).withColumn(name, T.padded(ids, size))
    return out.select("title", "words", "n_words", "entities", "n_entities")


def page_features(titles: DataFrame, words: DataFrame, links: DataFrame, word_vocab: DataFrame, entity_vocab: DataFrame, redirects: DataFrame, text_len: int = 5000, entity_len: int = 2000) -> DataFrame:
    """title, words, n_words, entities, n_entities of the titles, as they resolve, that have a page; others are left out. Of
    more than entity_len entities, which have no order, those stay that a hash chooses."""
    wanted = entities.target_titles(titles, redirects)
    there = words.join(wanted, "title", "left_semi")
    text = datasets.encoded_texts(there.select("title", "words"), word_vocab, text_len, "words", False).withColumnRenamed("length", "n_words")
    known = links.join(wanted, "title", "left_semi").join(datasets.sent(entity_vocab.select("token", "id"), "vocabulary"), "token")
    return _two_bags(there, text, _bag(known.select("title", "id", F.lit(1).alias("n")), "entities", entity_len), text_len, entity_len)


def _bag(counts: DataFrame, name: str, size: int) -> DataFrame:
    """title, <name> (ids), n_<name> of counts (title, id, n)."""
    return datasets.expanded(counts, ["title"], size).select("title", F.col("bag").alias(name), F.col("n").alias(f"n_{name}"))


def cooc_features(titles: DataFrame, word_counts: DataFrame, entity_counts: DataFrame, entity_vocab: DataFrame, redirects: DataFrame, text_len: int = 5000, entity_len: int = 2000) -> DataFrame:
    """The same from co-occurrences: bags of word and entity ids as often as they were counted, in an order fixed by a hash, and
    of too many those that it chooses. word_counts, entity_counts: row, col, n. Titles that are in no sentence are left out."""
    rows = saved(entities.target_titles(titles, redirects).join(entity_vocab.select(F.col("token").alias("title"), F.col("id").alias("row")), "title"), "rows")
    some = lambda counts: rows.join(counts, "row").select("title", F.col("col").alias("id"), "n")
    return _two_bags(rows, _bag(some(word_counts), "words", text_len), _bag(some(entity_counts), "entities", entity_len), text_len, entity_len)


def page_encodings(titles: DataFrame, pages: DataFrame, parts: DataFrame, redirects: DataFrame, encodings: dict[str, dict]) -> DataFrame:
    """encoding, title, words, entities (ids) of the titles, as they resolve, that have a page, for many classifiers at once.

    encodings: by name word_vocab, entity_vocab, text_len, entity_len, in_links, out_links, abstract_only. Pages and in-links
    are read and cut into tokens once, for all of them; every encoding's vocabulary is a part of one table that the tokens are
    joined with. As `page_features`, without padding.
    """
    there = pages.join(entities.target_titles(titles, redirects), "title", "left_semi").select("title", "paragraphs")
    both = F.array(*[F.struct(F.lit(a).alias("abstract_only"), T.lowered(T.tokens(entities.page_text(F.col("paragraphs"), a))).alias("words")) for a in sorted({e["abstract_only"] for e in encodings.values()})])
    each = there.select("title", F.explode("paragraphs").alias("p")).select("title", F.when(F.col("p.abstract"), "abstract").otherwise("rest").alias("kind"), F.explode("p.wiki_links.title").alias("token"))
    into = entities.in_links(parts).join(there.select("title"), "title", "left_semi").select("title", F.lit("in").alias("kind"), F.col("x.title").alias("token"))
    kinds = lambda e: (["in"] if e["in_links"] else []) + (["abstract"] if e["out_links"] else []) + (["rest"] if e["out_links"] and not e["abstract_only"] else [])
    one = lambda n, vocab, column, value: vocab.select("token", "id", F.lit(n).alias("encoding"), value.alias(column))
    words = functools.reduce(DataFrame.unionByName, [one(n, e["word_vocab"], "abstract_only", F.lit(e["abstract_only"])) for n, e in encodings.items()])
    names = functools.reduce(DataFrame.unionByName, [one(n, e["entity_vocab"], "kind", F.explode(F.array(*[F.lit(k) for k in kinds(e)]).cast("array<string>"))) for n, e in encodings.items()])
    tokens = there.select("title", F.explode(both).alias("x")).select("title", "x.abstract_only", F.posexplode("x.words").alias("pos", "token"))
    known = tokens.join(datasets.sent(words, "vocabularies"), ["abstract_only", "token"])
    ids = known.groupBy("encoding", "title").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("int")).alias("words"))
    linked = each.unionByName(into).distinct().join(datasets.sent(names, "vocabularies"), ["kind", "token"]).select("encoding", "title", "id").distinct().withColumn("n", F.lit(1))
    return _all_encodings(there, ids, linked, {n: (e["text_len"], e["entity_len"]) for n, e in encodings.items()})


def cooc_encodings(titles: DataFrame, word_counts: DataFrame, entity_counts: DataFrame, entity_vocab: DataFrame, redirects: DataFrame, lengths: dict[str, tuple[int, int]]) -> DataFrame:
    """The same from co-occurrences; lengths: by name text_len and entity_len. The matrices' rows are read once, and each bag is
    made for the longest; a shorter one is its end. As `cooc_features`, without padding."""
    rows = saved(entities.target_titles(titles, redirects).join(entity_vocab.select(F.col("token").alias("title"), F.col("id").alias("row")), "title"), "rows")
    some = lambda counts: rows.join(counts, "row").select("title", F.col("col").alias("id"), "n", F.lit("").alias("encoding"))
    words = datasets.expanded(some(word_counts), ["encoding", "title"], max(n for n, _ in lengths.values()), "words").drop("n")
    every = F.explode(F.array(*[F.lit(n) for n in lengths]))
    linked = some(entity_counts).withColumn("encoding", F.lit(""))
    return _all_encodings(rows, words, linked, lengths, every)


def _all_encodings(there: DataFrame, words: DataFrame, linked: DataFrame, lengths: dict[str, tuple[int, int]], every=None) -> DataFrame:
    """The titles that are there with each encoding's bags, cut to its lengths; every: the encodings of bags that all share."""
    bags = datasets.expanded(linked, ["encoding", "title"], max(n for _, n in lengths.values()), "entities").drop("n")
    names = F.explode(F.array(*[F.lit(n) for n in lengths]))
    out = there.select("title").distinct()
    if every is None:
        out = out.withColumn("encoding", names)
        out = out.join(words, ["encoding", "title"], "left").join(bags, ["encoding", "title"], "left")
    else:
        out = out.join(words.drop("encoding"), "title", "left").join(bags.drop("encoding"), "title", "left").withColumn("encoding", every)
    sizes = {k: F.create_map(*[x for n, v in lengths.items() for x in (F.lit(n), F.lit(v[k]))])[F.col("encoding")] for k in (0, 1)}
    end = lambda c, k: F.slice(c, F.greatest(F.size(c) - sizes[k] + 1, F.lit(1)), sizes[k])
    empty = F.array().cast("array<int>")
    return out.select("encoding", "title", F.coalesce(end(F.col("words"), 0), empty).alias("words"), F.coalesce(end(F.col("entities"), 1), empty).alias("entities"))


def classifier_dataset(features: DataFrame, kb: DataFrame, redirects: DataFrame, min_text_len: int = 5, min_entity_len: int = 5, dev: float = 0.05, test: float = 0.05) -> DataFrame:
    """title, words, entities, label, type_name, weight, split: the titles of one type that have more words and entities than
    the minima. Weights are by all titles of one type, as they are in the knowledge base, the heaviest class at 1."""
    single = datasets.single_type(kb)
    labels = datasets.type_labels(single).join(datasets.class_weights(single).select("type_name", F.col("scaled").alias("weight")), "type_name")
    some = datasets.long_enough(datasets.long_enough(features, min_text_len, "n_words"), min_entity_len, "n_entities")
    rows = entities.resolved(single, redirects).dropDuplicates(["title"]).join(some, "title").join(labels, "type_name")
    return datasets.split(rows, "title", dev, test).select("title", "words", "entities", "label", "type_name", "weight", "split")


def cached(spark: SparkSession, path: str, wanted: list[str], features_of, model_of) -> list[str]:
    """Logits of every classifier that isn't in the list of finished ones beside path yet, one partition each; the names of those
    that were done now. features_of(name): title, words, entities; model_of(name): (model, types)."""
    names = spark.createDataFrame([(n,) for n in wanted], "classifier string")
    left = {r["classifier"] for r in S.unfinished(names, S.finished(spark, path)).collect()}  # of those asked for
    now = [n for n in wanted if n in left]
    for name in now:
        model, types = model_of(name)
        S.add_classifier(learning.classify(features_of(name), model, types, name), name, path)
    return now


def score(asked: DataFrame, scorer: learning.Scorer, logits: DataFrame, kb: DataFrame, redirects: DataFrame, classifiers: list[str]) -> DataFrame:
    """asked (line_id, title, type_name, and more) with prediction and score."""
    rows = scoring.scoring_rows(asked, logits, kb, redirects, classifiers)
    return scoring.scores(scorer.predict(rows), scorer.binary).select(*asked.columns, "prediction", "score")


def run(spark: SparkSession, files: list[str], out_dir: str, scorers: dict[str, learning.Scorer], logits: dict[str, DataFrame], kbs: dict[str, DataFrame], redirects: DataFrame, classifiers: dict[str, list[str]]) -> list[str]:
    """Scores request files and writes a submission of the same name for each; scorers and the rest are by category, which the
    file's name tells. The folders written."""
    out = []
    for path in files:
        kind = S.category(path)
        asked = S.requests(spark, path)
        scored = score(asked, scorers[kind], logits[kind], kbs[kind], redirects, classifiers[kind])
        out.append(f"{out_dir}/{path.rstrip('/').rsplit('/', 1)[-1]}")
        S.write_submission(scored, out[-1])
    return out
