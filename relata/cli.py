"""Commands that build stored tables from one another and score requests: `python -m relata.cli <command> ...`.

Every path names a folder of Parquet tables, but for the inputs (a dump, a folder of TSV files, sentences, requests) and the
JSON list of features.
"""

from __future__ import annotations

import argparse
import functools
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import parse
from .operators import cooc, datasets, entities, learning, scoring, serving
from .scratch import saved
from .sources import tables as S


def _entities(spark: SparkSession, path: str):
    t = S.load_all(spark, path, ["titles", "redirects"])
    return t["titles"], t["redirects"]


def _kb(spark: SparkSession, a):
    return S.knowledge_base(spark, f"{a.dataset_dir}/{S.CATEGORIES[a.category]}.kb")


def build_entity_db(spark, a) -> None:
    """Titles, valid redirects and in-link counts of a dump."""
    dump = S.dump(spark, a.dump_file)
    titles, redirects = entities.titles_and_redirects(dump)
    links = entities.out_links(parse.parse_pages(dump))
    for name, table in {"titles": titles, "redirects": entities.valid_redirects(redirects, titles), "inlinks": entities.inlink_counts(links, titles, redirects)}.items():
        S.store_clustered(table, f"{a.out_file}/{name}", "title")


def build_page_db(spark, a) -> None:
    """Paragraphs and in-links of the pages that a knowledge base is about."""
    dump = S.dump(spark, a.dump_file)
    _, redirects = _entities(spark, a.entity_db_file)
    pages = entities.with_resolved_links(parse.parse_pages(dump), redirects)
    pages, in_links = entities.page_tables(pages, entities.out_links(pages), entities.target_titles(_kb(spark, a), redirects))
    S.store_clustered(pages, f"{a.out_file}/pages", "title")
    S.store_clustered(in_links, f"{a.out_file}/in_links", "title")


def build_sentence_db(spark, a) -> None:
    """Sentences with their links, titles resolved."""
    _, redirects = _entities(spark, a.entity_db_file)
    found = parse.parse_sentences(S.sentences(spark, a.sentences_file))
    S.store(sentences_resolved(found, redirects), a.out_file)


def sentences_resolved(found, redirects):
    """Parsed sentences with their links' titles followed through one redirect; only links that are redirects are joined back."""
    hops = found.select("sent_id", F.explode("wiki_links.title").alias("title")).distinct().join(redirects, "title")
    hops = hops.groupBy("sent_id").agg(F.map_from_entries(F.collect_list(F.struct("title", "dest"))).alias("hops"))

    def follow(x):
        return F.struct(F.coalesce(F.try_element_at(F.col("hops"), x["title"]), x["title"]).alias("title"), x["span_start"].alias("span_start"), x["span_end"].alias("span_end"))

    both = found.join(hops, "sent_id", "left")
    return both.select("sent_id", "text", F.when(F.col("hops").isNull(), F.col("wiki_links")).otherwise(F.transform("wiki_links", follow)).alias("wiki_links"))


def build_coocc_matrix(spark, a) -> None:
    """Vocabularies and word-entity and entity-entity counts of sentences."""
    found = parse.locate(S.load(spark, a.sentence_db_file))
    words = cooc.vocabulary(found.select(F.explode("words").alias("token")), a.min_word_count)
    names = cooc.vocabulary(found.select(F.explode("links.entity").alias("token")), 1)
    S.store_all({"word_vocab": words, "entity_vocab": names}, a.out_file)
    words, names = S.load_all(spark, a.out_file, ["word_vocab", "entity_vocab"]).values()
    S.store_counts(cooc.word_entity(found, a.word_window, words).withColumnRenamed("word", "other"), words, names, f"{a.out_file}/word", "other")
    S.store_counts(cooc.entity_entity(found).select(F.col("e1").alias("entity"), F.col("e2").alias("other"), "n"), names, names, f"{a.out_file}/entity", "other")


def _store_dataset(spark, features, a, words, names, options: dict) -> None:
    _, redirects = _entities(spark, a.entity_db_file)
    kb = _kb(spark, a)
    rows = serving.classifier_dataset(features, kb, redirects, a.min_text_len, a.min_entity_len, a.dev_size, a.test_size)
    S.store(rows, f"{a.out_file}/rows", ("split",))
    types = [r["type_name"] for r in datasets.type_labels(datasets.single_type(kb)).orderBy("label").collect()]
    about = {"types": types, "category": a.category, "text_len": a.text_len, "entity_len": a.entity_len, **options}
    S.store_all({"word_vocab": words, "entity_vocab": names, "about": spark.createDataFrame([(json.dumps(about),)], "about string")}, a.out_file)


def build_page_dataset(spark, a) -> None:
    """A classifier's dataset from pages."""
    bags = [saved(x, "bags") for x in serving.page_bags(*S.load_all(spark, a.page_db_file, ["pages", "in_links"]).values(), a.in_links, a.out_links, a.abstract_only)]
    words, names = serving.page_vocabularies(*bags, a.text_len, a.min_word_count, a.min_entity_count)
    _, redirects = _entities(spark, a.entity_db_file)
    features = serving.page_features(_kb(spark, a), *bags, words, names, redirects, a.text_len, a.entity_len)
    _store_dataset(spark, features, a, words, names, {"kind": "page", "in_links": a.in_links, "out_links": a.out_links, "abstract_only": a.abstract_only})


def _cooc_features(spark, kb, matrix: str, redirects, text_len: int, entity_len: int):
    t = S.load_all(spark, matrix, ["word", "entity", "entity_vocab"])
    return serving.cooc_features(kb, t["word"], t["entity"], t["entity_vocab"], redirects, text_len, entity_len)


def build_cooc_dataset(spark, a) -> None:
    """A classifier's dataset from co-occurrences."""
    _, redirects = _entities(spark, a.entity_db_file)
    features = _cooc_features(spark, _kb(spark, a), a.matrix_file, redirects, a.text_len, a.entity_len)
    vocabularies = S.load_all(spark, a.matrix_file, ["word_vocab", "entity_vocab"])
    _store_dataset(spark, features, a, *vocabularies.values(), {"kind": "cooc", "matrix": a.matrix_file})


def _dataset(spark, path: str):
    rows, about = S.load(spark, f"{path}/rows"), json.loads(S.load(spark, f"{path}/about").first()["about"])
    size = {n: S.load(spark, f"{path}/{n}_vocab").agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"] for n in ("word", "entity")}
    return rows, about, {"words": size["word"], "entities": size["entity"], "classes": len(about["types"])}


def _use(a) -> str:
    return "words" if a.word_only else "entities" if a.entity_only else "both"


def train_classifier(spark, a) -> dict:
    """A classifier from a dataset; its accuracy on dev and test rows."""
    rows, about, sizes = _dataset(spark, a.dataset_file)
    shape = {**sizes, "dim": a.dim_size, "hidden": a.hidden_units, "attention": a.attention, "attention_dim": a.attention_dim_size, "dropout": a.dropout_keep_prob, "use": _use(a), "seed": a.random_seed}
    train = rows.where("split = 'train'")
    model = learning.train_classifier(train if a.balanced_weight else train.withColumn("weight", F.lit(1.0)), shape, a.epoch, a.workers, batch=a.batch_size)
    measured = {s: learning.accuracy(rows.where(F.col("split") == s), model, about["types"]).first()["accuracy"] for s in ("dev", "test")}
    learning.save_model(spark, model, a.out_file, dataset=a.dataset_file, **about, **measured)
    return measured


def search_classifier(spark, a) -> dict:
    """The options of a classifier with the least loss on dev rows."""
    rows, _, sizes = _dataset(spark, a.dataset_file)
    shape = {**sizes, "attention": a.attention, "use": _use(a), "seed": a.random_seed}
    return learning.search_classifier(rows if a.balanced_weight else rows.withColumn("weight", F.lit(1.0)), shape, None, a.max_evals, a.epoch, a.batch_size, a.random_seed)


def cache_classifier_results(spark, a) -> list[str]:
    """Logits of classifiers for a knowledge base's titles; those already at out_file are skipped. The features of all that are
    left are made at once: pages are read once, and each matrix is."""
    _, redirects = _entities(spark, a.entity_db_file)
    kb, wanted = _kb(spark, a), S.listed(a.cooc_models, a.page_models)
    done = {r["classifier"] for r in S.finished(spark, a.out_file).collect()}
    models = {n: learning.load_model(spark, n) for n in wanted if n not in done}
    tables, page_set, matrices = [], {}, {}
    for name, (_, about) in models.items():
        if about["kind"] == "cooc":
            matrices.setdefault(about["matrix"], {})[name] = (about["text_len"], about["entity_len"])
        else:
            vocabularies = S.load_all(spark, about["dataset"], ["word_vocab", "entity_vocab"])
            page_set[name] = {**vocabularies, **{k: about[k] for k in ("text_len", "entity_len", "in_links", "out_links", "abstract_only")}}
    if page_set:
        tables.append(serving.page_encodings(kb, *S.load_all(spark, a.page_db_file, ["pages", "in_links"]).values(), redirects, page_set))
    for matrix, lengths in matrices.items():
        t = S.load_all(spark, matrix, ["word", "entity", "entity_vocab"])
        tables.append(serving.cooc_encodings(kb, t["word"], t["entity"], t["entity_vocab"], redirects, lengths))
    features = [saved(t, "features", ("encoding",)) for t in tables]
    every = functools.reduce(lambda x, y: x.unionByName(y), features) if features else None
    return serving.cached(spark, a.out_file, wanted, lambda n: every.where(F.col("encoding") == n), lambda n: (models[n][0], models[n][1]["types"]))


def _classifiers(logits) -> list[str]:
    return sorted(r["classifier"] for r in logits.select("classifier").distinct().collect())


def build_scorer_dataset(spark, a) -> None:
    """Features and labels of a training set."""
    logits, (_, redirects) = S.load(spark, a.cache_file), _entities(spark, a.entity_db_file)
    train = S.training_set(spark, f"{a.dataset_dir}/{S.CATEGORIES[a.category]}.train").withColumn("line_id", F.monotonically_increasing_id())
    S.store(scoring.scoring_rows(train, logits, _kb(spark, a), redirects, _classifiers(logits), a.binary).withColumn("binary", F.lit(a.binary)), a.out_file)


_NO_FEATURE = {"line_id", "title", "type_name", "score", "label", "fold", "binary"}


def _scorer_rows(spark, a):
    rows = S.load(spark, a.dataset_file)
    features = S.feature_list(a.feature_file) if getattr(a, "feature_file", None) else sorted(set(rows.columns) - _NO_FEATURE)
    binary = bool(rows.select("binary").first()["binary"]) if rows.limit(1).count() else False
    folded = datasets.folds(rows.withColumn("key", F.concat_ws("\t", "title", "type_name", F.col("line_id").cast("string"))), "key", getattr(a, "cv", 10)).drop("key")
    return scoring.projected(folded, ["title", "type_name", "fold", "label"], features), features, binary


def _trees(a, binary: bool) -> dict:
    return {"trees": a.n_estimators, "rate": a.learning_rate, "depth": a.max_depth, "min_split": a.min_samples_split, "subsample": a.subsample, "max_features": a.max_features or 1.0, "binary": binary}


def train_scorer(spark, a) -> None:
    """A stored scorer."""
    rows, features, binary = _scorer_rows(spark, a)
    learning.save_model(spark, learning.fit_scorer(rows, features, **_trees(a, binary)), a.out_file)


def evaluate(spark, a) -> dict:
    """Cross-validated accuracy, or errors and the shares within 1, 2 and 4."""
    rows, features, binary = _scorer_rows(spark, a)
    found = learning.cross_validated(rows, features, a.cv, **_trees(a, binary))
    return (scoring.binary_accuracy if binary else scoring.metrics)(found).first().asDict()


def select_features(spark, a) -> dict:
    """The best list of features, greedily, with its score."""
    rows, features, binary = _scorer_rows(spark, a)
    best = learning.select_features(rows, features, a.k_features, **_trees(a, binary))
    if a.out_file:
        S.write_feature_list(a.out_file, best["features"], best["score"])
    return best


def search_scorer(spark, a) -> dict:
    """The best options of the trees, with their score."""
    rows, features, binary = _scorer_rows(spark, a)
    space = {**learning.SCORER_SPACE, "max_features": list(range(min(3, len(features)), len(features) + 1))}
    return learning.search_hyper_params(rows, features, space, a.max_evals, a.random_state, trees=a.n_estimators, binary=binary)


def run(spark, a) -> list[str]:
    """Scores request files."""
    _, redirects = _entities(spark, a.entity_db)
    kinds = {S.category(f) for f in a.input_file}
    short = {v: k for k, v in S.CATEGORIES.items()}
    logits = {k: S.load(spark, getattr(a, f"{short[k]}_cache")) for k in kinds}
    scorers = {k: learning.load_model(spark, getattr(a, f"{short[k]}_model"))[0] for k in kinds}
    kbs = {k: S.knowledge_base(spark, f"{a.dataset_dir}/{k}.kb") for k in kinds}
    return serving.run(spark, a.input_file, a.output_dir, scorers, logits, kbs, redirects, {k: _classifiers(logits[k]) for k in kinds})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="relata", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(under, name: str, f, *arguments, **options):
        """arguments: a name, or (name, default) where it may be left out; options: their defaults, flags if booleans."""
        p = under.add_parser(name, help=f.__doc__)
        p.set_defaults(f=f)
        for x in arguments:
            p.add_argument(x) if isinstance(x, str) else p.add_argument(x[0], nargs="?", default=x[1])
        for key, value in options.items():
            flag = "--" + key.replace("_", "-")
            if isinstance(value, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=value)
            elif isinstance(value, tuple):
                p.add_argument(flag, type=value[0], default=None)
            elif isinstance(value, list):
                p.add_argument(flag, nargs="*", default=value)
            else:
                p.add_argument(flag, type=type(value), default=value, choices=list(S.CATEGORIES) if key == "category" else None)
        return p

    data, names = ("dataset_dir", "dataset"), ("entity_db_file", "entity_db")
    sizes = {"text_len": 5000, "min_text_len": 5, "entity_len": 2000, "min_entity_len": 5, "dev_size": 0.05, "test_size": 0.05}
    network = {"batch_size": 100, "epoch": 1, "random_seed": 0, "word_only": False, "entity_only": False, "attention": True, "balanced_weight": False}
    trees = {"n_estimators": 1000, "learning_rate": 0.01, "max_depth": 3, "min_samples_split": 30, "max_features": (int,), "subsample": 1.0}
    command(commands, "build_entity_db", build_entity_db, "dump_file", ("out_file", "entity_db"))
    command(commands, "build_page_db", build_page_db, "dump_file", "out_file", data, names, category="pro")
    command(commands, "build_sentence_db", build_sentence_db, ("sentences_file", "dataset/wiki-sentences"), names, ("out_file", "sentence.db"))
    command(commands, "train_classifier", train_classifier, "dataset_file", "out_file", hidden_units=2000, dropout_keep_prob=0.5, dim_size=100, attention_dim_size=10, workers=1, **network)
    command(commands, "search_hyper_params", search_classifier, "dataset_file", max_evals=100, **network)
    pages = commands.add_parser("page_classifier").add_subparsers(dest="sub", required=True)
    command(pages, "build_dataset", build_page_dataset, "page_db_file", "out_file", data, names, category="pro", abstract_only=False, min_word_count=5, min_entity_count=5, in_links=True, out_links=True, random_seed=0, **sizes)
    matrix = commands.add_parser("coocc_classifier").add_subparsers(dest="sub", required=True)
    command(matrix, "build_coocc_matrix", build_coocc_matrix, "out_file", ("sentence_db_file", "sentence.db"), word_window=(int,), min_word_count=5)
    command(matrix, "build_dataset", build_cooc_dataset, "matrix_file", "out_file", data, names, category="pro", random_seed=0, **sizes)
    scorer = commands.add_parser("scorer").add_subparsers(dest="sub", required=True)
    command(scorer, "cache_classifier_results", cache_classifier_results, "page_db_file", "out_file", data, names, category="pro", cooc_models=[], page_models=[])
    command(scorer, "train_model", train_scorer, "dataset_file", "out_file", feature_file=(str,), **trees)
    command(scorer, "evaluate", evaluate, "dataset_file", feature_file=(str,), cv=10, **trees)
    command(scorer, "build_dataset", build_scorer_dataset, "cache_file", "out_file", data, names, category="pro", binary=True)
    command(scorer, "select_features", select_features, "dataset_file", out_file=(str,), cv=10, k_features=(int,), **trees)
    command(scorer, "search_hyper_params", search_scorer, "dataset_file", feature_file=(str,), cv=10, max_evals=5000, n_estimators=1000, random_state=0)
    command(scorer, "run", run, input_file=[], output_dir=".", dataset_dir="dataset", entity_db="entity_db", pro_cache="pro_cache", nat_cache="nat_cache", pro_model="pro_model", nat_model="nat_model")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(arguments)
    return a.f(spark or SparkSession.builder.appName("relata").getOrCreate(), a)


if __name__ == "__main__":
    found = main()
    if found is not None:
        print(json.dumps(found))
