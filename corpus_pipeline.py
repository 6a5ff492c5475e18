"""A corpus pipeline: toxic documents go, near and repeated text goes, sources are mixed to weights, and the rest is packed.

Every stage takes documents (doc_id, text, and any more columns) and, but for the last, returns the columns that it got. In all
of them column names besides doc_id, text and source don't matter, an empty table gives an empty one, and a very long text is
read whole, by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm import mixing, neardup, packing, repeats, toxicity
from relata.llm.scratch import saved


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where docs has it, is that of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, by a model learned from the labels of sf_dir. Rows are judged alone, by their
    text: null and empty texts have the score of no match, repeated rows stay or go together; a null doc_id has no label to
    learn from, and is scored like any other."""
    return docs.where(toxicity.score(F.col("text"), toxicity.model_for(spark, docs, sf_dir)) < 0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of five-word shingles): that with the smallest id; of rows with that id,
    the one with the smallest text, null first. Null and empty texts are copies of nothing. Rows without an id stay."""
    kept = neardup.near_duplicates(docs, k=5).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.where("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("id")).join(kept.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("row.text", F.xxhash64("row")))).where("n = 1").select("row.*")
    return rows.unionByName(docs.where("doc_id IS NULL"))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that documents with smaller ids have. Null texts stay null; rows of one id
    take nothing from each other; a null id counts as the largest."""
    return _measured(repeats.without_repeats(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents up to its budget, some of them twice, the last one in part. Null and wordless texts have nothing
    to give and go; a null source is a source of its own; rows of one id stand side by side, in the order of size and text."""
    return _measured(mixing.mixed_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their sequences and offsets; repeated rows are packed as often as they are there, a
    null or empty text is its end alone, a null id stays null."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("near_dedup", distinct), ("substring_dedup", unrepeated), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer have no SQL; the tests compare each stage with plain Python.
ORACLE_SQL = None
