"""Catalogs on storage: documents, and postings in ranges of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from lexistrata.operators.index import Index, documents, optimize, postings_of_words, ranged_by_word
from lexistrata.sources import storage


def save(index: Index, path: str, mode: str = "error") -> None:
    """Documents as they come; postings purged, ranged and sorted by word, so that a look-up of a word reads few row groups."""
    index.docs.write.mode(mode).parquet(f"{path}/docs")
    optimize(index).postings.write.mode(mode).parquet(f"{path}/postings")


def index_texts(df: DataFrame, path: str, id_col: str, uri: Column, text_col: str, attrs: Column | None = None) -> None:
    """A catalog of texts, each analysed once: postings are made from the words that were written with the documents."""
    documents(df, id_col, uri, text_col, attrs).write.parquet(f"{path}/docs")
    written = df.sparkSession.read.parquet(f"{path}/docs")
    ranged_by_word(postings_of_words(written)).write.parquet(f"{path}/postings")


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"))


_made: dict[tuple[str, str], str] = {}


def opened(spark: SparkSession, name: str, make: Callable[[str], None]) -> Index:
    """The application's catalog of that name: made into a folder of the shared storage at its first use, read from there ever
    after."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _made:
        path = storage.scratch(spark, "catalog")
        make(path)
        _made[key] = path
    return load(spark, _made[key])
