"""Reading dumps, knowledge bases, training sets, sentences and requests; storing and loading tables, features and submissions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import saved

CATEGORIES = {"pro": "profession", "nat": "nationality"}


def dump(spark: SparkSession, path: str, ignored: tuple[str, ...] = T.IGNORED_NAMESPACES) -> DataFrame:
    """title, wiki_text, redirect of an XML dump's articles (bz2 files too).

    Records are what ends with a page's end tag, cut by the text source, which also cuts inside of bz2 files, at their blocks: so
    tasks share a dump of one or many streams, and a page that lies across a split is read by the one where it begins. Each
    record is then parsed as XML; what isn't a page, such as the site's head, is left out."""
    schema = "title string, revision struct<text: struct<_VALUE: string>>"
    records = spark.read.text(path, lineSep="</page>").where(F.contains("value", F.lit("<page>")))
    one = F.concat(F.expr("substr(value, locate('<page>', value))"), F.lit("</page>"))
    pages = records.select(F.from_xml(one, schema, {"ignoreSurroundingSpaces": "false"}).alias("p")).where("p.title IS NOT NULL").select("p.title", F.coalesce("p.revision.text._VALUE", F.lit("")).alias("wiki_text"))
    return pages.where(T.article(F.col("title"), ignored)).withColumn("redirect", T.redirect(F.col("wiki_text")))


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote="", mode="FAILFAST")


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "title string, type_name string")


def training_set(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "title string, type_name string, score int")


def category(path: str) -> str:
    """A request's category, by its file name."""
    return "nationality" if "nationality" in path.rstrip("/").rsplit("/", 1)[-1] else "profession"


def catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The knowledge bases and training sets of a folder, by file name."""
    out = {f"{c}.kb": knowledge_base(spark, f"{folder}/{c}.kb") for c in ("nationality", "profession")}
    return out | {f"{c}.train": training_set(spark, f"{folder}/{c}.train") for c in ("nationality", "profession")}


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, line: one sentence a line; the id is unique, and rises with a file's lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("sent_id"), F.col("value").alias("line"))


def numbered_requests(lines: DataFrame) -> DataFrame:
    """line_id, title, type_name, first_seen (the title's first line) of lines (line_id, value): two fields, more are ignored."""
    parts = F.split(F.rtrim("value"), "\t")
    rows = lines.select("line_id", F.get(parts, 0).alias("title"), F.get(parts, 1).alias("type_name"))
    return rows.withColumn("first_seen", F.min("line_id").over(Window.partitionBy("title")))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """`numbered_requests` of a file."""
    return numbered_requests(spark.read.text(path).withColumn("line_id", F.monotonically_increasing_id()))


def store(table: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A table as Parquet, partitioned by columns if asked."""
    table.write.mode("overwrite").partitionBy(*by).parquet(path) if by else table.write.mode("overwrite").parquet(path)


def store_all(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables under one folder, each by its name: titles, redirects and in-links; word and entity counts with their
    vocabularies; and so on."""
    for name, table in tables.items():
        store(table, f"{folder}/{name}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A stored table. Only the columns and row groups that a plan asks for are read."""
    return spark.read.parquet(path)


def load_all(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: load(spark, f"{folder}/{n}") for n in names}


def store_clustered(table: DataFrame, path: str, key: str, distinct: int = 1_000_000, group_bytes: int = 16 << 20) -> None:
    """A table in ranges of a key, each a file in order of it with a Bloom filter of the keys, so that a lookup reads the row
    groups that may have them: their statistics leave out other ranges, and their filters keys that aren't there. distinct: how
    many keys a row group's filter is made for. The rows are saved before they are ordered, since ranges are drawn from a sample of them."""
    ordered = saved(table, "unordered").repartitionByRange(key).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(distinct), "parquet.block.size": str(group_bytes)}
    ordered.write.mode("overwrite").options(**options).parquet(path)


def lookup(table: DataFrame, key: str, wanted: DataFrame | list) -> DataFrame:
    """The rows of the keys wanted; an unknown key gives none. A few keys are pushed down to the scan, where `store_clustered`
    has left row groups to skip; a table of them is joined."""
    if isinstance(wanted, DataFrame):
        return table.join(wanted.select(key).distinct(), key, "left_semi")
    return table.where(F.col(key).isin(list(wanted)))


def store_counts(counts: DataFrame, words: DataFrame, entities: DataFrame, path: str, column: str) -> None:
    """A sparse matrix of counts (entity, <column>, n) as rows of ids: `store_ids`."""
    ids = counts.join(entities.select(F.col("token").alias("entity"), F.col("id").alias("row")), "entity")
    ids = ids.join(words.select(F.col("token").alias(column), F.col("id").alias("col")), column)
    store_ids(ids, path)


def store_ids(counts: DataFrame, path: str) -> None:
    """A sparse matrix of counts (row, col, n) in order of rows. They are saved before they are ordered, since the ranges are drawn
    from a sample of them."""
    ids = saved(counts.select("row", "col", F.col("n").cast("long").alias("n")), "counts")
    store(ids.repartitionByRange("row").sortWithinPartitions("row", "col"), path)


def feature_list(path: str) -> list[str]:
    with open(path) as f:
        return json.load(f)["features"]


def write_feature_list(path: str, features: list[str], score: float) -> None:
    with open(path, "w") as f:
        json.dump({"features": features, "score": score}, f, sort_keys=True, indent=2)


def submission(scored: DataFrame) -> DataFrame:
    """title, type_name, score of scored requests, titles in the order in which they were first asked for."""
    return scored.orderBy("first_seen", "line_id").select("title", "type_name", F.col("score").cast("int"))


def write_submission(scored: DataFrame, path: str) -> None:
    """`submission` as TSV files of ranges: in order of their names, end to end, they are the whole. The rows are saved before they
    are ordered, so that ranges are of the same rows as the sample that they are drawn from."""
    submission(saved(scored.select("title", "type_name", "score", "first_seen", "line_id"), "scored")).write.mode("overwrite").csv(path, sep="\t", quote="")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """classifier: those whose logits are all at path, by the list beside it. A list that is there but can't be read raises."""
    listed_ = f"{path}-finished"
    return spark.read.schema("classifier string").parquet(listed_) if exists(spark, listed_) else spark.createDataFrame([], "classifier string")


def add_classifier(logits: DataFrame, name: str, path: str) -> None:
    """A classifier's logits as a partition of their own, then its name in the list of finished ones. A partition that isn't listed,
    from a run that broke off, is written over."""
    logits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("classifier").parquet(path)
    logits.sparkSession.createDataFrame([(name,)], "classifier string").coalesce(1).write.mode("append").parquet(f"{path}-finished")


def unfinished(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Classifiers without logits yet."""
    return wanted.join(done.select("classifier").distinct(), "classifier", "left_anti")


def listed(cooc: list[str], pages: list[str]) -> list[str]:
    """All classifiers' names: those on co-occurrences, then those on pages."""
    return [*cooc, *pages]
