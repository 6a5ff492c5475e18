"""Counts over a stream of sentences; the same plans as over a table, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def word_counts(lines: DataFrame) -> DataFrame:
    """token, n over lines (line), a table or a stream (output mode complete or update)."""
    return lines.select(F.explode(T.lowered(T.tokens(F.col("line")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def sentence_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).withColumnRenamed("value", "line")
