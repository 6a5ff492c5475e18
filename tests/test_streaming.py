from relata.streaming import sentences


def test_counts_of_a_stream(spark, tmp_path):
    """A stream's counts, kept up to date, are those of the table of all its lines."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("One two\ntwo é\n")
    counts = sentences.word_counts(sentences.sentence_stream(spark, str(tmp_path / "in")))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    (tmp_path / "in/b").write_text("TWO three\n")
    query.processAllAvailable()
    query.stop()
    found = sorted(map(tuple, spark.table("counted").collect()))
    table = sentences.word_counts(spark.read.text(str(tmp_path / "in")).withColumnRenamed("value", "line"))
    assert found == sorted(map(tuple, table.collect())) == [("one", 1), ("three", 1), ("two", 3), ("é", 1)]
