"""Incremental indexing: a stream of documents keeps postings up to date, a micro-batch at a time.

An extension: documents arrive as a stream (id, uri, date, text); each micro-batch is deduplicated, analysed and appended as a
version-stamped part. Reads take the latest version of every uri, so a batch never rewrites what is there, and a batch that is
replayed after a failure replaces its own part: results count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexistrata.operators.index import Index, postings


def _write(batch: DataFrame, number: int, path: str) -> None:
    newest = Window.partitionBy("uri").orderBy(F.desc("date"), F.desc("id"))
    docs = batch.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    docs.select("id", "uri", "date").write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
    postings(docs, "id", "text").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")


def index_stream(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts indexing of a streaming DataFrame (id, uri, date, text) into path; trigger as DataStreamWriter.trigger takes it."""
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: _write(df, n, path))
    return (writer.trigger(**trigger) if trigger else writer).start()


def current(spark: SparkSession, path: str) -> Index:
    """The index as of the batches that are complete: the newest document of every uri, and only its postings."""
    docs, posts = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")
    last = docs.groupBy("uri").agg(F.max_by(F.struct("id", "batch"), F.struct("batch", "date", "id")).alias("d")).select("uri", "d.id", "d.batch")
    live = posts.join(last.select("id", "batch"), ["id", "batch"], "left_semi").select("word", "id", "score")
    return Index(last.select("id", "uri"), live)


def windowed_terms(tokens: DataFrame, time_col: str, word_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of words in tumbling windows of event time; what comes later than `late` is dropped by the watermark. State is
    one count for each word and open window."""
    return tokens.withWatermark(time_col, late).groupBy(F.window(time_col, window), word_col).agg(F.count("*").alias("n")).select("window.start", word_col, "n")
