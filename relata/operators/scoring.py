"""From type statistics and logits to features, labels, metrics and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .datasets import multi_type
from .entities import resolved

NAMES = ["proba", "value", "top_proba", "bottom_proba", "top_raw", "bottom_raw", "pmi"]


def type_statistics(kb: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(titles: n; singles: type_name, n; pairs: type_a, type_b, n, in order of name) over titles of several types. A pair is
    counted for every two rows of a title."""
    several = multi_type(kb)
    rows = several.withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy("type_name")))
    total = several.agg(F.countDistinct("title").alias("titles"))
    singles = several.groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))
    a, b = rows.selectExpr("title", "place p", "type_name type_a"), rows.selectExpr("title", "place q", "type_name type_b")
    pairs = a.join(b, "title").where("p < q").groupBy("type_a", "type_b").agg(F.count(F.lit(1)).alias("n"))
    return total, singles, pairs


def pmi(kb: DataFrame) -> DataFrame:
    """type_a, type_b, n, pmi: the smoothed ratio p(a, b) / (p(a) p(b)), with p = (count + 1) / titles."""
    total, singles, pairs = type_statistics(kb)
    p = lambda c: (F.col(c) + 1) / F.col("titles")
    rows = pairs.crossJoin(F.broadcast(total)).join(singles.selectExpr("type_name type_a", "n n_a"), "type_a").join(singles.selectExpr("type_name type_b", "n n_b"), "type_b")
    return rows.select("type_a", "type_b", "n", (p("n") / (p("n_a") * p("n_b"))).alias("pmi"))


def ratios(rows: DataFrame, kb: DataFrame) -> DataFrame:
    """rows (type_name, predicted) with pmi, the ratio of the two types; what was never counted has a count of 0."""
    total, singles, pairs = type_statistics(kb)
    rows = rows.withColumn("type_a", F.least("type_name", "predicted")).withColumn("type_b", F.greatest("type_name", "predicted")).crossJoin(F.broadcast(total))
    rows = rows.join(pairs.withColumnRenamed("n", "n_ab"), ["type_a", "type_b"], "left")
    rows = rows.join(singles.selectExpr("type_name", "n n_t"), "type_name", "left").join(singles.selectExpr("type_name predicted", "n n_p"), "predicted", "left")
    p = lambda c: (F.coalesce(F.col(c), F.lit(0)) + 1) / F.col("titles")
    return rows.withColumn("pmi", p("n_ab") / (p("n_t") * p("n_p"))).drop("type_a", "type_b", "titles", "n_ab", "n_t", "n_p")


def softmax(logits: DataFrame) -> DataFrame:
    """logits (classifier, title, type_name, value) with proba, in 32-bit exponentials and without a shift."""
    e = F.exp(F.col("value").cast("float").cast("double"))
    return logits.withColumn("proba", e / F.sum(e).over(Window.partitionBy("classifier", "title")))


def valid(logits: DataFrame, asked: DataFrame) -> DataFrame:
    """Logits of asked (title, type_name) pairs; a title without any leaves its classifier out."""
    return logits.join(asked.select("title", "type_name").distinct(), ["title", "type_name"], "left_semi")


def features(logits: DataFrame, kb: DataFrame) -> DataFrame:
    """Seven features of each (classifier, title, type_name): from probabilities and raw values, their distances to the largest
    and smallest of the title's valid types, and the ratio with the type predicted (ties go to the last name)."""
    w = Window.partitionBy("classifier", "title")
    rows = logits.withColumn("predicted", F.max(F.struct("value", "type_name")).over(w)["type_name"])
    for name, c in (("proba", "proba"), ("raw", "value")):
        rows = rows.withColumn(f"top_{name}", F.max(c).over(w) - F.col(c)).withColumn(f"bottom_{name}", F.min(c).over(w) - F.col(c))
    clean = [T.sanitized(F.col(c).cast("double")).alias(c) for c in NAMES]
    return ratios(rows, kb).select("classifier", "title", "type_name", *clean)


def request_features(asked: DataFrame, logits: DataFrame, kb: DataFrame, redirects: DataFrame) -> DataFrame:
    """line_id, classifier and its seven features of each asked row (line_id, title, type_name).

    Titles are looked up as what they redirect to, but each asked title has its own valid types: those asked for that the
    classifier knows. Probabilities are over all of a classifier's types. A type that it doesn't know has probability and
    value 0. A classifier that lacks the title, or knows none of its types, gives no row. logits: classifier, title, type_name,
    value; kb: title, type_name.
    """
    want = resolved(asked.select("line_id", F.col("title").alias("asked"), "title", "type_name"), redirects)
    there = softmax(logits)
    mine = want.select("asked", "title", "type_name").distinct().join(there, ["title", "type_name"])
    best = mine.groupBy("classifier", "asked").agg(F.max(F.struct("value", "type_name"))["type_name"].alias("predicted"), *[f(c).alias(f"{n}_{c}") for c in ("proba", "value") for n, f in (("top", F.max), ("bottom", F.min))])
    rows = want.select("line_id", "asked", "type_name").join(best, "asked")
    rows = rows.join(mine.select("classifier", "asked", "type_name", "proba", "value"), ["classifier", "asked", "type_name"], "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("proba", "value")})
    differences = {f"{n}_{short}": F.col(f"{n}_{c}").cast("double") - F.col(c) for c, short in (("proba", "proba"), ("value", "raw")) for n in ("top", "bottom")}
    rows = ratios(rows.withColumns(differences), kb)
    return rows.select("line_id", "classifier", *[T.sanitized(F.col(c).cast("double")).alias(c) for c in NAMES])


def scoring_rows(asked: DataFrame, logits: DataFrame, kb: DataFrame, redirects: DataFrame, classifiers: list[str], binary: bool = False) -> DataFrame:
    """The rows that a scorer learns from or predicts for: asked (line_id, title, type_name, and score if known) with num_types,
    the number of the title's rows, and a column <classifier>_<feature> for each classifier, 0 where it has none. Known scores
    give a label; binary leaves out the middle ones."""
    wide_ = request_features(asked, logits, kb, redirects).groupBy("line_id").pivot("classifier", classifiers).agg(*[F.first(n).alias(n) for n in NAMES])
    names = [f"{c}_{n}" for c in classifiers for n in NAMES]
    rows = asked.withColumn("num_types", F.count(F.lit(1)).over(Window.partitionBy("title")).cast("double")).join(wide_, "line_id", "left").na.fill(0.0, names)
    return labelled(rows, binary) if "score" in asked.columns else rows


def wide(rows: DataFrame, classifiers: list[str]) -> DataFrame:
    """One row per (title, type_name): a column per classifier and feature, 0 where there is none, and num_types."""
    pivoted = rows.groupBy("title", "type_name").pivot("classifier", classifiers).agg(*[F.first(n).alias(n) for n in NAMES])
    return pivoted.na.fill(0.0).withColumn("num_types", F.count(F.lit(1)).over(Window.partitionBy("title")))


def projected(rows: DataFrame, wanted: list[str], features: list[str] | None = None) -> DataFrame:
    """rows with the columns `wanted` and the features, all of them doubles: those that rows lack are 0, others go."""
    there = set(rows.columns)
    return rows.select(*wanted, *[(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in there else F.lit(0.0)).alias(f) for f in features or sorted(there - set(wanted))])


def labelled(rows: DataFrame, binary: bool) -> DataFrame:
    """rows (score) with label; binary leaves out scores 3 and 4 and asks whether the score is at least 5."""
    if not binary:
        return rows.withColumn("label", F.col("score").cast("double"))
    return rows.where(~F.col("score").isin(3, 4)).withColumn("label", (F.col("score") >= 5).cast("double"))


def scores(predictions: DataFrame, binary: bool) -> DataFrame:
    value = F.when(F.col("prediction") >= 0.5, 5).otherwise(2) if binary else T.rounded(F.col("prediction"))
    return predictions.withColumn("score", value.cast("int"))


def metrics(rows: DataFrame) -> DataFrame:
    """Means over folds of rows (fold, label, prediction): accuracy of rounded predictions, mae, mae_raw, and the shares within
    1, 2 and 4. Errors are those of predictions as they are, beyond 0 and 7 too."""
    off = F.abs(F.round("prediction") - F.col("label"))
    by_fold = rows.groupBy("fold").agg(F.avg((off == 0).cast("double")).alias("accuracy"), F.avg(off).alias("mae"), F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae_raw"), *[F.avg((off <= k).cast("double")).alias(f"delta_{k}") for k in (1, 2, 4)])
    return by_fold.agg(*[F.avg(c).alias(c) for c in ("accuracy", "mae", "mae_raw", "delta_1", "delta_2", "delta_4")])


def binary_accuracy(rows: DataFrame) -> DataFrame:
    """accuracy of predicted probabilities, the mean over folds of rows (fold, label, prediction)."""
    right = ((F.col("prediction") >= 0.5).cast("double") == F.col("label")).cast("double")
    return rows.groupBy("fold").agg(F.avg(right).alias("a")).agg(F.avg("a").alias("accuracy"))
