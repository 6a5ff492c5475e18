import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.functions import parse
from relata.operators import cooc, datasets, entities, learning, pooling, scoring, serving
from relata.plans import queries
from relata.sources import tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_redirect_chain_counts(spark):
    titles = spark.createDataFrame([("A",), ("B",), ("C",)], "title string")
    redirects = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "gone")], "title string, dest string")
    links = spark.createDataFrame([("A",)] * 2 + [("B",)] * 3 + [("C",)], "title string")
    assert rows(entities.inlink_counts(links, titles, redirects)) == [("A", 0), ("B", 2), ("C", 4)]
    ok = entities.valid_redirects(redirects, titles)
    assert rows(entities.resolved(titles, ok)) == [("B",), ("C",), ("C",)]
    assert rows(entities.target_titles(titles, ok)) == [("B",), ("C",)]
    assert rows(entities.contained(spark.createDataFrame([("A",), ("x",)], "title string"), titles)) == [("A",)]
    assert entities.size(titles).first()["n"] == 3


def test_page_table_resolves_links(spark):
    texts = [("P", "see [[Old|a]] and [[Q]]\n"), ("Q", "see [[Old]] [[P]]\n"), ("Old", "#REDIRECT [[New]]\nx\n"), ("New", "none\n")]
    dump = spark.createDataFrame(texts, "title string, wiki_text string").withColumn("redirect", F.when(F.col("title") == "Old", "New"))
    kb = spark.createDataFrame([("Old", "t"), ("P", "t"), ("absent", "t")], "title string, type_name string")
    pages, parts = entities.page_database(dump, parse.parse_pages(dump), kb)
    found = {r["title"]: r for r in pages.collect()}
    assert sorted(found) == ["New", "P"]
    assert sorted((r["title"], r["x"]["title"], r["x"]["text"]) for r in entities.in_links(parts).collect()) == [("New", "P", "a"), ("New", "Q", "Old"), ("P", "Q", "P")]
    assert [x["title"] for x in found["P"]["paragraphs"][0]["wiki_links"]] == ["New", "Q"]


def test_window_uses_unknown_tokens(spark):
    s = spark.createDataFrame([(1, "x y E z w", [("E", 4, 5)]), (2, "", []), (3, None, None), (4, "alone", [("E", 0, 5)])], "sent_id long, text string, wiki_links array<struct<title: string, span_start: int, span_end: int>>")
    located = parse.locate(s)
    assert rows(cooc.word_entity(located, 1)) == [("E", "y", 1), ("E", "z", 1)]
    assert rows(cooc.word_entity(located, 1, spark.createDataFrame([("z",)], "token string"))) == [("E", "z", 1)]
    assert rows(cooc.word_entity(located, None)) == [("E", w, 1) for w in "wxyz"]
    assert rows(cooc.word_entity(located, 0)) == rows(cooc.word_entity(located, None))
    assert rows(cooc.linked_entities(located)) == [("E",)]


def test_windows_are_counted_in_tasks_that_follow_the_input(spark, monkeypatch):
    monkeypatch.setattr(cooc, "parts_of", lambda df: 37, raising=False)
    one = "words array<string>, links array<struct<entity: string, before: int, after: int>>"
    lines = [(["a", "e", "b"], [("E", 1, 2), ("Only", 0, 3)]), (["a", "e", "", "c"], [("E", 1, 2)]), (["e"], [("E", 0, 1)]), ([], []), (None, None)]
    s = spark.createDataFrame(lines * 60, one).repartition(20)
    found = cooc.word_entity(s, 2)
    assert found.rdd.getNumPartitions() == 37
    assert rows(found) == [("E", "", 60), ("E", "a", 120), ("E", "b", 60), ("E", "c", 60)]
    assert rows(cooc.word_entity(s, 2, spark.createDataFrame([("a",), ("c",), ("z",)], "token string"))) == [("E", "a", 120), ("E", "c", 60)]


def test_vocabulary_order(spark):
    words = ["b"] * 7 + ["a"] * 7 + ["abc"] * 6 + ["abd"] * 6 + ["é"] * 5 + ["rare"] * 4
    found = cooc.vocabulary(spark.createDataFrame([(w,) for w in words], "token string"))
    assert [r["token"] for r in found.orderBy("id").collect()] == ["a", "b", "abc", "abd", "é"]
    assert rows(found.select("id")) == [(k,) for k in range(1, 6)]


def test_fold_sizes(spark):
    counts = datasets.folds(spark.range(11), "id", 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in counts] == [4, 4, 3]
    assert rows(datasets.folds(spark.range(2), "id", 3).select("fold")) == [(1,), (2,)]
    assert datasets.folds(spark.range(0), "id", 3).count() == 0


def test_split_is_exact(spark):
    counts = {r["split"]: r["count"] for r in datasets.split(spark.range(59), "id", 0.1, 0.2).groupBy("split").count().collect()}
    assert counts == {"dev": 5, "test": 11, "train": 43}


def test_smoothed_ratio(spark):
    kb = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "c"), ("3", "a"), ("3", "d"), ("4", "e"), ("4", "f"), ("5", "a")], "title string, type_name string")
    found = {(r["type_a"], r["type_b"]): r["pmi"] for r in scoring.pmi(kb).collect()}
    assert abs(found["a", "b"] - 1.0) < 1e-12


def test_binary_labels(spark):
    df = spark.createDataFrame([(s,) for s in (2, 3, 4, 5)], "score int")
    assert rows(scoring.labelled(df, True)) == [(2, 0.0), (5, 1.0)]


def test_request_features_skip_classifiers(spark):
    """A classifier that knows none of a title's types, or not the title, gives no features; a type that it lacks has zeros."""
    logits = spark.createDataFrame([("a", "T", "x", 2.0), ("a", "T", "y", 1.0), ("b", "T", "z", 1.0), ("a", "U", "x", 1.0)], "classifier string, title string, type_name string, value float")
    asked = spark.createDataFrame([(0, "old", "x"), (1, "old", "w"), (2, "none", "x")], "line_id long, title string, type_name string")
    kb = spark.createDataFrame([("1", "x"), ("1", "w"), ("2", "x"), ("2", "w")], "title string, type_name string")
    hops = spark.createDataFrame([("old", "T")], "title string, dest string")
    found = {(r["line_id"], r["classifier"]): r for r in scoring.request_features(asked, logits, kb, hops).collect()}
    assert sorted(found) == [(0, "a"), (1, "a")]
    p = np.exp(2) / (np.exp(2) + np.exp(1))
    assert found[0, "a"]["proba"] == pytest.approx(p) and found[1, "a"]["proba"] == 0 and found[1, "a"]["top_raw"] == 2
    assert found[1, "a"]["pmi"] == pytest.approx((3 / 2) / (3 / 2 * 3 / 2))
    wide = scoring.scoring_rows(asked, logits, kb, hops, ["a", "b"]).orderBy("line_id").collect()
    assert [r["num_types"] for r in wide] == [2, 2, 1] and wide[2]["a_proba"] == 0 and wide[0]["b_proba"] == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(300, 3))
    y = np.where(x[:, 0] > 0.5, 5.0, 1.0)
    assert np.abs(learning.Trees(60, 0.2).fit(x, y).predict(x) - y).mean() < 0.1
    p = learning.Trees(60, 0.2, binary=True, max_features=2, subsample=0.8).fit(x, (y > 3).astype(float)).predict(x)
    assert ((p > 0.5) == (y > 3)).mean() > 0.98


def _scored(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(200, 3))
    data = [(f"t{k}", "a", int(k % 4 + 1), float(7 * (v[1] > 0.5)), *map(float, v)) for k, v in enumerate(x)]
    return spark.createDataFrame(data, "title string, type_name string, fold int, label double, f0 double, f1 double, f2 double")


def test_stored_scorer_predicts_the_same(spark, tmp_path):
    data = _scored(spark)
    model = learning.fit_scorer(data, ["f0", "f1", "f2"], trees=30, rate=0.2)
    learning.save_model(spark, model, f"{tmp_path}/m", note="x")
    again, about = learning.load_model(spark, f"{tmp_path}/m")
    a, b = (m.predict(data.drop("f2")).orderBy("title").select("prediction").collect() for m in (model, again))
    assert a == b and about == {"note": "x"}
    assert data.count() == len(a) and abs(a[0]["prediction"] - data.orderBy("title").first()["label"]) < 1
    linear = learning.Scorer(["f0"], False, linear=[2.0, 1.0])
    assert linear.predict(spark.createDataFrame([(3.0,)], "f0 double")).first()["prediction"] == 7.0


def test_mllib_trees(spark):
    model = learning.fit_large(_scored(spark), ["f0", "f1", "f2"], trees=3, rate=0.5)
    found = model.transform(_scored(spark)).select("label", "prediction").collect()
    assert np.mean([abs(r["label"] - r["prediction"]) for r in found]) < 1


def test_cross_validation_of_many_rows(spark, monkeypatch):
    many = _scored(spark)
    found = learning.cross_validated_large(many, ["f0", "f1", "f2"], 4, trees=2, rate=0.5).collect()
    assert len(found) == 200 and np.mean([abs(r["label"] - r["prediction"]) for r in found]) < 1.5
    two = learning.cross_validated_large(many.withColumn("label", (F.col("label") > 3).cast("double")), ["f0", "f1", "f2"], 2, trees=2, binary=True).collect()
    assert all(0 < r["prediction"] < 1 for r in two)
    monkeypatch.setattr(learning, "MOST_ROWS", 100)
    for f in (learning.fit_scorer, learning.cross_validated):
        with pytest.raises(ValueError):
            f(many, ["f0"])


def test_selection_and_search(spark):
    best = learning.select_features(_scored(spark), ["f0", "f1", "f2"], 2, trees=10, rate=0.3)
    assert best["features"][0] == "f1"
    ties = lambda rows, trials: [0.5 for _ in trials]
    assert learning.select_features(None, ["a", "b"], scored=ties) == {"features": ["a", "b"], "score": 0.5}  # first feature, last step
    assert learning.search_hyper_params(_scored(spark), ["f1"], {"depth": [1, 2]}, 2, trees=5)["score"] < 0
    assert learning.last_best([{"score": 1, "k": 0}, {"score": 1, "k": 1}])["k"] == 1 and learning.first_best([1, 2, 2]) == 1


@pytest.mark.parametrize("use", ["both", "words", "entities"])
@pytest.mark.parametrize("attention", [True, False])
def test_classifier_learns(use, attention):
    words, names, labels = [[1, 2, 0], [2, 1], [3, 4], [4, 3, 3]] * 20, [[1], [1, 1], [2], [2, 0]] * 20, [0, 0, 1, 1] * 20
    model = learning.Classifier(4, 2, 2, 8, 8, attention, 4, 0.2, use)
    history = model.fit(words, names, labels, dev=(words[:4], names[:4], labels[:4]), epochs=40, batch=16, rate=0.01)
    assert history[-1]["acc"] == history[-1]["val_acc"] == 1 and history[-1]["val_loss"] < history[0]["val_loss"]
    again = learning.Classifier.loads(model.dumps())
    assert np.allclose(again.logits(words, names), model.logits(words, names), atol=1e-4)


def test_pooling_equals_its_definition():
    """A softmax over all places, padding too, then the masked weighted sum at unit length."""
    m = learning.Classifier(5, 0, 2, 6, 4, True, 3, 0.0, "words", 3)
    ids = np.array([0, 0, 3, 1, 3])
    a = np.exp(m.p["a0"][ids] @ m.p["d0"])
    v = ((a / a.sum() * (ids != 0))[:, None] * m.p["e0"][ids]).sum(axis=0)
    assert np.allclose(m._pool(0, [ids])[3][0], v / np.linalg.norm(v))


def test_gradients():
    m = learning.Classifier(3, 2, 3, 4, 5, True, 2, 0.0, "both", 1)
    data = [[[1, 2, 2], [3]], [[1], [2, 2]]], np.array([0, 2])
    seen = {}
    m._adam = lambda name, g, rate, at: seen.__setitem__(name, (g, at))
    before = m.measured(data[0], data[1])[0]
    m._step(data[0], data[1], np.ones(2), 0.1, np.random.default_rng(0))
    for name, (g, at) in seen.items():
        flat = np.zeros_like(m.p[name])
        flat[at] = g
        step = np.random.default_rng(2).normal(size=flat.shape) * 1e-6
        m.p[name] += step
        assert (m.measured(data[0], data[1])[0] - before) / 2 == pytest.approx(float((flat * step).sum()) / 2, abs=1e-10), name
        m.p[name] -= step


def test_distributed_training(spark):
    data = [(f"t{k}", [1 + k % 2, 3], [k % 2 + 1], k % 2, 1.0, "dev" if k % 5 == 0 else "train") for k in range(60)]
    df = spark.createDataFrame(data, "title string, words array<int>, entities array<int>, label int, weight double, split string")
    shape = {"words": 3, "entities": 2, "classes": 2, "dim": 8, "hidden": 8, "attention_dim": 4, "dropout": 0.0}
    model = learning.train_classifier(df, shape, 30, 3, rate=0.02, batch=8)
    assert learning.accuracy(df, model, ["a", "b"]).first()["accuracy"] == 1
    best = learning.search_classifier(df, {**shape}, {"hidden": [4, 8], "dropout": [0.1]}, 2, 2)
    assert best["dropout"] == 0.1 and best["val_loss"] < 1


def test_models_are_averaged_outside_of_the_driver(spark, monkeypatch):
    """Blocks of ids that Spark averages, and examples that go by in the epoch's order, give what numpy gives from whole shares;
    the driver makes no model with embeddings, and hands their table over in pieces."""
    rng = np.random.default_rng(5)
    data = [(f"t{k}", [int(x) for x in rng.integers(0, 9001, 40)], [int(x) for x in rng.integers(1, 3, k % 3)], k % 3, 1.0 + k % 2) for k in range(90)]
    df = spark.createDataFrame(data, "title string, words array<int>, entities array<int>, label int, weight double").repartition(5)
    shape, options = {"words": 9000, "entities": 2, "classes": 3, "dim": 4, "hidden": 6, "attention_dim": 2, "dropout": 0.5}, {"batch": 8, "rate": 0.02}
    worker = {r["title"]: r["w"] for r in df.select("title", F.expr("pmod(hash(title), 3)").alias("w")).collect()}
    want = learning.Classifier(**shape)
    for round_ in range(2):
        start, parts = want.dumps(), [sorted(d for d in data if worker[d[0]] == w) for w in range(3)]
        want.p = {k: np.zeros_like(v) for k, v in want.p.items()}
        for part in sorted(parts):
            m = learning.Classifier.loads(start)
            m.fit(*[[d[k] for d in part] for k in (1, 2, 3, 4)], seed=round_, measure=False, **options)
            for k, v in learning.Classifier.loads(m.dumps()).p.items():
                want.p[k] += v * (len(part) / len(data))
    made, init, pieces, piece = [], learning.Classifier.__init__, [], pooling._piece
    monkeypatch.setattr(learning.Classifier, "__init__", lambda self, words, entities, *a, **b: (made.append(words), init(self, words, entities, *a, **b))[1])
    monkeypatch.setattr(pooling, "_piece", lambda part, dim: (pieces.append(part.count()), piece(part, dim))[1])
    monkeypatch.setattr(pooling, "PIECE", 100_000)
    trained = learning.train_stored(df, shape, 2, 3, **options)
    found = {(r["title"], r["type_name"]): r["value"] for r in learning.classify(df, trained, ["x", "y", "z"], "n").collect()}
    assert set(made) == {0} and len(pieces) == 5 + 1 and sum(pieces) == 9002 and max(pieces) < 2500
    monkeypatch.undo()
    model = trained.whole()
    assert all(np.array_equal(model.p[k], want.p[k]) for k in want.p)
    logits = want.logits([d[1] for d in data], [d[2] for d in data])
    assert all(found[d[0], t] == pytest.approx(logits[k, j], abs=1e-5) for k, d in enumerate(data) for j, t in enumerate("xyz"))
    assert np.array_equal(learning.train_stored(df.where("label > 5"), shape, 2, 3).whole().p["e0"], learning.Classifier(**shape).p["e0"])  # no rows


def test_steps_of_many_ids_equal_those_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    rows, labels = [[rng.integers(0, 50, int(n)) for n in rng.integers(0, 90, 30)] for _ in range(2)], rng.integers(0, 2, 30)

    def fitted(step):
        monkeypatch.setattr(learning, "STEP", step)
        m = learning.Classifier(50, 50, 2, 6, 5, True, 3, 0.3)
        m.fit(*rows, labels, batch=7, epochs=2, rate=0.02)
        return m.p

    a, b = fitted(1 << 20), fitted(16)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_attention_classifier_reads_whole_texts(spark, tmp_path, monkeypatch):
    """Words past the first 60 are features, up to the last 5,000 ids; the vocabulary counts the first 5,000 words."""
    texts = [["a"] * 60 + ["b"] * 30, ["a"] * 5000 + ["late"] * 30 + ["b"] * 9, ["c"] * 60 + ["d"] * 30]
    spark.createDataFrame([(k, " ".join(w), "en" if k < 2 else "fr") for k, w in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries.learning, "classify", lambda rows, *_: rows)
    found = {r["title"]: r for r in queries.attention_classifier(spark, str(tmp_path)).collect()}
    want = [[1] * 60 + [3] * 30, [1] * 4991 + [3] * 9, [2] * 60 + [4] * 30]
    assert [list(found[str(k)]["words"]) for k in range(3)] == want
    assert [found[str(k)]["length"] for k in range(3)] == [90, 5009, 90]


def test_cached_logits_resume(spark, tmp_path, monkeypatch):
    """A run that breaks off after a classifier's rows, or in the middle of them, leaves nothing that is there twice later."""
    m = learning.Classifier(2, 1, 2, 4, 4, use="words")
    rows_ = spark.createDataFrame([("T", [1, 2], [])], "title string, words array<int>, entities array<int>")
    model_of, path = lambda n: (m, ["x", "y"]), f"{tmp_path}/cache"
    assert serving.cached(spark, path, ["p"], lambda n: rows_, model_of) == ["p"]
    assert serving.cached(spark, path, ["q", "p"], lambda n: rows_, model_of) == ["q"]
    spark.createDataFrame([("r", "T", "x", 1.0)], "classifier string, title string, type_name string, value float").write.mode("append").partitionBy("classifier").parquet(path)  # half of r
    assert serving.cached(spark, path, ["q", "r"], lambda n: rows_, model_of) == ["r"]
    assert serving.cached(spark, path, ["q", "r"], lambda n: rows_, model_of) == []
    assert rows(spark.read.parquet(path).groupBy("classifier").count()) == [("p", 2), ("q", 2), ("r", 2)]
    (tmp_path / "cache-finished/part-bad.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        serving.cached(spark, path, ["p"], lambda n: rows_, model_of)


def test_submission_in_parts(spark, tmp_path):
    """Several files, which by their names are in order."""
    scored = spark.range(5000).select(F.col("id").alias("line_id"), F.concat(F.lit("t"), F.col("id") % 700).alias("title"), F.lit("x").alias("type_name"), (F.col("id") % 8).alias("score"), (F.col("id") % 700).alias("first_seen")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_submission(scored, f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("part-*"))
    lines = [x.split("\t") for f in parts for x in f.read_text().splitlines()]
    assert len(parts) > 1 and lines == [[f"t{g}", "x", str(k % 8)] for g in range(700) for k in range(g, 5000, 700)]


def test_lookup_reads_few_row_groups(spark, tmp_path):
    """A key is looked for in the row groups that may have it; one that isn't there, but between others, in none or so."""
    table = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("title"), "id")
    tables.store_clustered(table.repartition(3), f"{tmp_path}/t", "title", 5_000, 64 << 10)
    stored = tables.load(spark, f"{tmp_path}/t")
    key = hashlib.md5(b"77").hexdigest()

    def read(wanted):
        found = tables.lookup(stored, "title", [wanted])
        n = found.collect()
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        leaf = leaf.plan().collectLeaves().apply(0) if "Stage" in leaf.getClass().getName() else leaf
        return n, leaf.metrics().apply("numOutputRows").value()

    some, n = read(key)
    assert [r["id"] for r in some] == [77] and 0 < n < 8_000
    none, n = read(key[:-1] + "z")
    assert not none and n == 0  # in the range of a file, whose filter lacks it


def test_pooling_table_equals_the_model(spark):
    m = learning.Classifier(6, 4, 3, 5, 7, True, 3, 0.0, "both", 2)
    bags = [("a", [0, 0, 3, 1, 3], [2]), ("b", [6], []), ("c", [], [4, 4, 1]), ("d", [0], None), ("e", [99], [1])]
    df = spark.createDataFrame(bags, "title string, words array<int>, entities array<int>").repartition(3)
    found = {}
    for r in learning.classify(df, m, ["x", "y", "z"], "n").collect():
        found.setdefault(r["title"], {})[r["type_name"]] = r["value"]
    known = [([i for i in w if i < 7], e or []) for _, w, e in bags]
    want = m.logits([w for w, _ in known], [e for _, e in known])
    assert np.allclose([[found[t][x] for x in "xyz"] for t, _, _ in bags], want, atol=1e-5)


def test_in_links_in_parts(spark):
    """Half of all pages link to one title; no list has much more than it should, and the parts are all links."""
    links = spark.range(4000).select(F.concat(F.lit("s"), "id").alias("source"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("title"), F.lit("x").alias("text"))
    parts = entities.in_link_parts(links, links.select("title").union(spark.createDataFrame([("none",)], "title string")), 50).collect()
    hot = [r for r in parts if r["title"] == "hot"]
    assert len(hot) == 40 and max(len(r["links"]) for r in hot) <= 100 and all(len(r["links"]) == 8 for r in parts if r["title"] != "hot")
    assert sorted(x["title"] for r in hot for x in r["links"]) == sorted(f"s{k}" for k in range(0, 4000, 2))


def test_pairs_of_a_long_line(spark):
    """A line of 2,000 links gives its pairs from many rows of two blocks each, and the same as without blocks."""
    line = [{"entity": f"e{k:04d}", "before": k, "after": k + 1} for k in range(2000)]
    s = spark.createDataFrame([(line,), (line[:3] + line[:1],), ([],), (line[:1],)], "links array<struct<entity: string, before: int, after: int>>")
    pairs = cooc.entity_entity(s, 100)
    assert pairs.count() == 2000 * 1999 and pairs.where("n = 2").count() == 6
    few = s.where("size(links) < 2000")
    assert rows(cooc.entity_entity(few, 2)) == rows(cooc.entity_entity(few))


def test_bags_are_bounded(spark, monkeypatch):
    """Against all copies; and where the bar lets too few pass, without one."""
    counts = [("big", 1, 70_000), ("big", 2, 3), ("big", 3, 5_000), ("small", 7, 2), ("small", 8, 1), ("one", 9, 1), ("edge", 5, 40), ("none", 4, 0)]
    df = spark.createDataFrame(counts, "k string, id int, n long")

    def bag(key, size):
        copies = sorted((hashlib.md5(f"{i}-{c}".encode()).hexdigest(), i) for k, i, n in counts if k == key for c in range(1, n + 1))
        return [i for _, i in copies[-size:]]

    want = sorted((k, tuple(bag(k, 40)), sum(n for x, _, n in counts if x == k)) for k in ("big", "small", "one", "edge"))
    assert sorted((r["k"], tuple(r["bag"]), r["n"]) for r in datasets.expanded(df, ["k"], 40).collect()) == want
    monkeypatch.setattr(datasets, "SPREADS", -6)
    assert sorted((r["k"], tuple(r["bag"]), r["n"]) for r in datasets.expanded(df, ["k"], 40).collect()) == want


def test_encodings_at_once(spark):
    """Those of many classifiers, as if each were made alone."""
    link = lambda t: {"title": t, "text": t, "link_type": "out"}
    pages = spark.createDataFrame([(f"T{k}", [{"text": f"a b c{k} a", "wiki_links": [link("X"), link(f"Y{k % 3}")], "abstract": True}, {"text": "d e b", "wiki_links": [link("Z"), link("X")], "abstract": False}]) for k in range(9)] + [("empty", [])], f"title string, paragraphs {parse.PARAGRAPHS}")
    parts = entities.in_link_parts(spark.createDataFrame([(f"S{j}", f"T{k}", "x") for k in range(9) for j in range(k)], "source string, title string, text string"), pages, 3)
    hops = spark.createDataFrame([("old", "T2")], "title string, dest string")
    kb = spark.createDataFrame([("old",), ("T1",), ("T8",), ("empty",), ("absent",)], "title string").withColumn("type_name", F.lit("t"))
    vocab = lambda *w: spark.createDataFrame([(x, k + 1) for k, x in enumerate(w)], "token string, id int")
    made = {
        "p": {"word_vocab": vocab("a", "b", "d"), "entity_vocab": vocab("X", "S0", "S1", "S2", "S3", "Z"), "text_len": 4, "entity_len": 3, "in_links": True, "out_links": True, "abstract_only": False},
        "q": {"word_vocab": vocab("b", "e", "a"), "entity_vocab": vocab("Z", "X", "S1"), "text_len": 9, "entity_len": 9, "in_links": False, "out_links": True, "abstract_only": True},
        "r": {"word_vocab": vocab("a"), "entity_vocab": vocab("S0", "X"), "text_len": 1, "entity_len": 2, "in_links": True, "out_links": False, "abstract_only": True},
    }
    found = {(r["encoding"], r["title"]): (r["words"], r["entities"]) for r in serving.page_encodings(kb, pages, parts, hops, made).collect()}
    want = {}
    for n, e in made.items():
        words, links = serving.page_bags(pages, parts, e["in_links"], e["out_links"], e["abstract_only"])
        for r in serving.page_features(kb, words, links, e["word_vocab"], e["entity_vocab"], hops, e["text_len"], e["entity_len"]).collect():
            want[n, r["title"]] = ([x for x in r["words"] if x], [x for x in r["entities"] if x])
    assert found == want and len(want) == 12 and any(w for w, _ in want.values())
    counts = spark.createDataFrame([(1, c, 3 * c) for c in range(1, 9)] + [(2, 1, 2)], "row int, col int, n long")
    names = vocab("T2", "T1", "T8")
    both = {(r["encoding"], r["title"]): (r["words"], r["entities"]) for r in serving.cooc_encodings(kb, counts, counts, names, hops, {"a": (5, 40), "b": (200, 2)}).collect()}
    want = {}
    for n, (x, y) in {"a": (5, 40), "b": (200, 2)}.items():
        for r in serving.cooc_features(kb, counts, counts, names, hops, x, y).collect():
            want[n, r["title"]] = ([i for i in r["words"] if i], [i for i in r["entities"] if i])
    assert both == want and len(want) == 6


@pytest.mark.parametrize("binary", [False, True])
def test_trees_of_many_equal_rows(spark, monkeypatch, binary):
    """More rows than a task may hold, of which few differ."""
    rng = np.random.default_rng(2)
    data = [(f"t{k}", "a", k % 3 + 1, float((a + b > 5) if binary else a), float(a), None if b == 4 else float(b)) for k, (a, b) in enumerate(rng.integers(0, 6, (900, 2)).tolist())]
    many = spark.createDataFrame(data, "title string, type_name string, fold int, label double, f0 double, f1 double")
    found = []
    for most in (1000, 200):
        monkeypatch.setattr(learning, "MOST_ROWS", most)
        model = learning.fit_scorer(many, ["f0", "f1"], trees=10, rate=0.3, binary=binary)
        for rows in (learning.cross_validated(many, ["f0", "f1"], 3, trees=10, rate=0.3, binary=binary), model.predict(many)):
            found.append([(r["title"], round(r["prediction"], 9)) for r in rows.orderBy("title").collect()])
    assert found[:2] == found[2:] and len(found[0]) == 900
    part = learning.cross_validated(many, ["f0", "f1"], 3, trees=10, rate=0.3, subsample=0.5, max_features=1, binary=binary).collect()
    assert len(part) == 900 and np.mean([abs(r["label"] - r["prediction"]) for r in part]) < 1


def test_quantiles_of_counted_values():
    rng = np.random.default_rng(3)
    values, n, ranks = rng.uniform(size=40), rng.integers(1, 9, 40), np.linspace(0, 1, 65)
    assert np.array_equal(learning._quantiles(values, n, ranks), np.quantile(np.repeat(values, n), ranks))


def test_texts_are_encoded_in_place(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("é", 3)], "token string, id int")
    texts = spark.createDataFrame([("x", ["b", "no", "a", "b", None]), ("none", ["no"]), ("null", None), ("empty", []), ("y", ["é"] * 6)], "title string, words array<string>")
    found = datasets.encoded_texts(texts, vocab, 4, "ids", False)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found.select("title", F.array_join("ids", " "), "length")) == [("x", "2 1 2", 3), ("y", "3 3 3 3", 6)]
    for most in (500_000, 1):
        monkeypatch.setattr(datasets, "MOST_SENT", most)
        assert rows(datasets.encoded_texts(texts, vocab, 4).select("title", F.array_join("ids", " "))) == [("x", "0 2 1 2"), ("y", "3 3 3 3")]


def test_bags_are_pooled_in_place_by_parts_of_a_table(spark, monkeypatch):
    table = spark.createDataFrame([(k, [float(k), 1.0 - k, 0.5], 1 / (1 + k)) for k in range(1, 30)], pooling.TABLE)
    bags = spark.createDataFrame([("x", [1, 2, 2, 29, 0, 77]), ("unknown", [0, 99]), ("null", None), ("y", list(range(1, 30)) * 9)], "title string, ids array<int>")
    values = lambda found: [(r["title"], [round(v, 9) for v in r["vector"]]) for r in found.orderBy("title").collect()]
    whole = pooling.pooled(bags, table)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    x = np.sum([np.array([k, 1.0 - k, 0.5]) * n / (1 + k) for k, n in ((1, 1), (2, 2), (29, 1))], axis=0)
    assert [t for t, _ in values(whole)] == ["x", "y"] and np.allclose(values(whole)[0][1], x / np.linalg.norm(x))
    monkeypatch.setattr(pooling, "MOST_PART", 200)
    monkeypatch.setattr(pooling, "STEP", 7)
    assert values(pooling.pooled(bags, table)) == values(whole)


def test_pairs_of_ids_are_those_of_names(spark):
    s = spark.createDataFrame([(k, [(e,) for e in names]) for k, names in enumerate(("ab", "bca", "cc", "d", ""))], "sent_id long, links array<struct<entity: string>>")
    names = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2), ("d", 4)], "token string, id int")
    by_name = {e: i for e, i in names.collect()}
    pairs = rows(cooc.entity_entity(cooc.entity_ids(s, names)))
    assert pairs == sorted((by_name[a], by_name[b], n) for a, b, n in rows(cooc.entity_entity(s))) and len(pairs) == 6


def test_models_are_stored_without_python_tasks(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise AssertionError("a Python task")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", fail)
    learning.save_model(spark, learning.Scorer(["f0"], False, linear=[2.0, 1.0]), f"{tmp_path}/m", note="é")
    model, about = learning.load_model(spark, f"{tmp_path}/m")
    assert model.linear == [2.0, 1.0] and about == {"note": "é"}
