"""From a dump to a submission by the commands, and the sources and sinks on their way."""

import bz2
import json
import random
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from relata import cli
from relata.sources import tables as S

NAMES = [f"Person {k}" for k in range(40)]


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    d = tmp_path_factory.mktemp("work")
    (d / "dataset").mkdir()
    kind = lambda k: ("singer", "painter")[k % 2]
    pages = [("Old", "#REDIRECT [[Person 1]]"), ("File:x", "[[Person 1]]\n"), ("Art", "paint\n")]
    for k, n in enumerate(NAMES):
        tool = ("song stage voice", "brush oil canvas")[k % 2]
        links = " ".join(f"[[{m}|m]]" for m in (("Stage", "Song"), ("Art", "Oil"))[k % 2])
        pages.append((n, f"{n} is known for {tool} {tool} {links} [[Old]]\n== Life ==\nmore {tool}\n"))
    xml = "".join(f"<page><title>{t}</title><ns>0</ns><revision><text>{w}</text></revision></page>" for t, w in pages)
    (d / "dump.xml.bz2").write_bytes(bz2.compress(f"<mediawiki>{xml}</mediawiki>".encode()))
    lines = [f"then [{n.replace(' ', '_')}|{n}] took the {('voice song stage', 'brush oil canvas')[k % 2]} with [Old|him] and [Art|art]" for k, n in enumerate(NAMES) for _ in range(3)]
    (d / "sentences").write_text("\n".join(lines) + "\n")
    kb = [(n, kind(k)) for k, n in enumerate(NAMES)] + [("Person 3", "singer"), ("Person 4", "painter"), ("Person 6", "painter"), ("Person 8", "painter"), ("Person 8", "dancer")]
    (d / "dataset/profession.kb").write_text("".join(f"{a}\t{b}\n" for a, b in kb))
    (d / "dataset/profession.train").write_text("".join(f"{n}\t{t}\t{7 if t == kind(k) else 0}\n" for k, n in enumerate(NAMES[:30]) for t in ("singer", "painter")))
    for c in ("kb", "train"):
        (d / f"dataset/nationality.{c}").write_text("")
    (d / "profession.test").write_text("Person 8\tsinger\tmore\nOld\tpainter\nPerson 8\tpainter\nNobody\tsinger\n")
    return d


@pytest.fixture(scope="module")
def built(spark, work):
    def do(*arguments):
        return cli.main([str(a) for a in arguments], spark)

    do("build_entity_db", work / "dump.xml.bz2", work / "entities")
    do("build_page_db", work / "dump.xml.bz2", work / "pages", work / "dataset", work / "entities")
    do("build_sentence_db", work / "sentences", work / "entities", work / "sentence.db")
    do("coocc_classifier", "build_coocc_matrix", work / "matrix", work / "sentence.db", "--word-window", 5, "--min-word-count", 3)
    small = ["--min-text-len", 1, "--min-entity-len", 0, "--dev-size", 0.1, "--test-size", 0.1, "--text-len", 20, "--entity-len", 6]
    do("page_classifier", "build_dataset", work / "pages", work / "page_set", work / "dataset", work / "entities", "--min-word-count", 3, "--min-entity-count", 3, *small)
    do("coocc_classifier", "build_dataset", work / "matrix", work / "cooc_set", work / "dataset", work / "entities", *small)
    net = ["--hidden-units", 16, "--dim-size", 8, "--epoch", 30, "--batch-size", 8, "--dropout-keep-prob", 0.1]
    accuracy = [do("train_classifier", work / f"{k}_set", work / f"{k}_model", "--balanced-weight", *net) for k in ("page", "cooc")]
    cache = ["scorer", "cache_classifier_results", work / "pages", work / "pro_cache", work / "dataset", work / "entities", "--page-models", work / "page_model", "--cooc-models", work / "cooc_model"]
    assert do(*cache) == [str(work / "cooc_model"), str(work / "page_model")]
    assert do(*cache) == []
    do("scorer", "build_dataset", work / "pro_cache", work / "scorer_set", work / "dataset", work / "entities", "--no-binary")
    do("scorer", "train_model", work / "scorer_set", work / "pro_model", "--n-estimators", 40, "--learning-rate", 0.2, "--min-samples-split", 4)
    return do, accuracy


def test_entity_tables(spark, work, built):
    t = S.load_all(spark, str(work / "entities"), ["titles", "redirects", "inlinks"])
    assert t["titles"].count() == len(NAMES) + 2 and [tuple(r) for r in t["redirects"].collect()] == [("Old", "Person 1")]
    assert S.lookup(t["inlinks"], "title", ["Person 1", "Old", "nobody"]).orderBy("title").collect() == S.lookup(t["inlinks"], "title", t["titles"].where("title IN ('Person 1', 'Old')")).orderBy("title").collect()
    assert {r["title"]: r["n"] for r in t["inlinks"].collect()} | {"Person 1": 40, "Old": 0, "Art": 20} == {r["title"]: r["n"] for r in t["inlinks"].collect()}


def test_page_and_sentence_tables(spark, work, built):
    pages = {r["title"]: r for r in S.load(spark, str(work / "pages/pages")).collect()}
    assert sorted(pages) == sorted(NAMES) and S.load(spark, str(work / "pages/in_links")).where("title = 'Person 1'").selectExpr("sum(size(links))").first()[0] == 40
    assert [p["abstract"] for p in pages["Person 1"]["paragraphs"]][0] and "Person 1" in {x["title"] for x in pages["Person 2"]["paragraphs"][0]["wiki_links"]}
    s = S.load(spark, str(work / "sentence.db")).orderBy("sent_id").first()
    assert s["text"].startswith("then Person 0 took") and [x["title"] for x in s["wiki_links"]] == ["Person 0", "Person 1", "Art"]
    assert s["text"][s["wiki_links"][1]["span_start"] : s["wiki_links"][1]["span_end"]] == "him"


def test_matrix(spark, work, built):
    t = S.load_all(spark, str(work / "matrix"), ["word", "entity", "word_vocab", "entity_vocab"])
    ids = {r["token"]: r["id"] for r in t["entity_vocab"].collect()}
    words = {r["token"]: r["id"] for r in t["word_vocab"].collect()}
    count = {(r["row"], r["col"]): r["n"] for r in t["word"].collect()}
    assert count[ids["Person 0"], words["song"]] == 3 and count[ids["Art"], words["him"]] == 120
    pairs = {(r["row"], r["col"]): r["n"] for r in t["entity"].collect()}
    assert pairs[ids["Art"], ids["Person 1"]] == pairs[ids["Person 1"], ids["Art"]] == 120


def test_classifier_sets(spark, work, built):
    for kind in ("page", "cooc"):
        rows = S.load(spark, str(work / f"{kind}_set/rows"))
        assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"dev": 3, "test": 3, "train": 30}
        assert {len(r["words"]) for r in rows.collect()} == {20} and {len(r["entities"]) for r in rows.collect()} == {6}
        assert json.loads(S.load(spark, str(work / f"{kind}_set/about")).first()["about"])["types"] == ["painter", "singer"]


def test_learned(spark, work, built):
    do, accuracy = built
    assert all(a["test"] == 1 for a in accuracy)
    found = do("scorer", "evaluate", work / "scorer_set", "--cv", 3, "--n-estimators", 30, "--learning-rate", 0.2, "--min-samples-split", 4)
    assert found["mae"] < 1
    best = do("scorer", "select_features", work / "scorer_set", "--out-file", work / "features.json", "--cv", 3, "--k-features", 1, "--n-estimators", 5, "--learning-rate", 0.5, "--min-samples-split", 4)
    assert S.feature_list(str(work / "features.json")) == best["features"] and len(best["features"]) == 1
    assert json.loads((work / "features.json").read_text())["score"] == best["score"]
    do("scorer", "train_model", work / "scorer_set", work / "small_model", "--feature-file", work / "features.json", "--n-estimators", 5)
    assert cli.learning.load_model(spark, str(work / "small_model"))[0].features == best["features"]
    assert do("scorer", "search_hyper_params", work / "scorer_set", "--cv", 2, "--max-evals", 2, "--n-estimators", 5)["score"] <= 0
    assert do("search_hyper_params", work / "page_set", "--max-evals", 1, "--epoch", 1)["val_acc"] >= 0
    do("scorer", "build_dataset", work / "pro_cache", work / "binary_set", work / "dataset", work / "entities")
    assert do("scorer", "evaluate", work / "binary_set", "--cv", 3, "--n-estimators", 20, "--learning-rate", 0.2, "--min-samples-split", 4)["accuracy"] > 0.9


def test_submission(spark, work, built):
    do, _ = built
    out, = do("scorer", "run", "--input-file", work / "profession.test", "--output-dir", work / "out", "--dataset-dir", work / "dataset", "--entity-db", work / "entities", "--pro-cache", work / "pro_cache", "--pro-model", work / "pro_model")
    lines = [x.split("\t") for f in sorted((work / "out/profession.test").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x[:2] for x in lines] == [["Person 8", "singer"], ["Person 8", "painter"], ["Old", "painter"], ["Nobody", "singer"]]
    scores = {tuple(x[:2]): int(x[2]) for x in lines}
    assert scores["Person 8", "singer"] >= 5 and scores["Person 8", "painter"] <= 2 and 0 <= scores["Old", "painter"] <= 7


def test_dump_of_many_streams_and_blocks(spark, tmp_path):
    """Streams of several blocks each, cut anywhere in a page: read by several tasks, each page once."""
    r = random.Random(2)
    texts = ["".join(chr(r.randrange(0x61, 0x250)) for _ in range(r.randrange(1, 20_000))) + " &amp; é <b>\n" for _ in range(300)]
    xml = "<mediawiki><siteinfo><x>page</x></siteinfo>\n" + "\n".join(f"<page><title>P {k}</title><ns>0</ns><revision><id>1</id><text bytes=\"9\" xml:space=\"preserve\">{escape(t)}</text></revision></page>" for k, t in enumerate(texts)) + "\n</mediawiki>\n"
    raw = xml.encode()
    cuts = [0, *sorted(r.sample(range(len(raw)), 3)), len(raw)]
    (tmp_path / "dump.xml.bz2").write_bytes(b"".join(bz2.compress(raw[a:b], 1) for a, b in zip(cuts, cuts[1:])))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(300_000))
    try:
        found = S.dump(spark, str(tmp_path / "dump.xml.bz2")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((x["title"], x["wiki_text"]) for x in found) == sorted((f"P {k}", t) for k, t in enumerate(texts))
    assert len({x["task"] for x in found}) > 3


def test_catalog_and_names(spark, work):
    tables = S.catalog(spark, str(work / "dataset"))
    assert tables["profession.kb"].count() == 45 and tables["profession.train"].dtypes[2] == ("score", "int") and tables["nationality.kb"].count() == 0
    assert S.category("/x/nationality.test") == "nationality" and S.category("nationality/profession.test") == "profession"
    assert S.listed(["c"], ["p"]) == ["c", "p"]
    (work / "bad.kb").write_text("one\n")
    with pytest.raises(Exception):
        S._tsv(spark, str(work / "bad.kb"), "title string, type_name string, score int").where(F.col("score").isNull()).collect()


def test_all_commands_are_there():
    def names(p, prefix=""):
        for a in p._subparsers._group_actions if p._subparsers else []:
            for n, q in a.choices.items():
                yield from names(q, f"{prefix}{n} ") if q._subparsers else [f"{prefix}{n}"]

    assert len(list(names(cli.parser()))) == 15
