"""Display modes of a search: matching lines, word summaries, uri filters, counters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_uris(results: DataFrame, docs: DataFrame, pattern: str) -> DataFrame:
    """Results whose document's uri matches; results without a document are left out. The pattern is applied to documents
    before the join."""
    return results.join(docs.where(F.col("uri").rlike(pattern)).select("id", "uri"), "id")


def numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 1), line."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_p", "line")).select("id", (F.col("_p") + 1).alias("line_no"), "line")


def line_pattern(words: list[str], mode: str) -> str:
    """any, first: any of the words; all: every word, in the query's order."""
    glue = ".*" if mode == "all" else "|"
    return glue.join(f"({re.escape(w)})" for w in words) if mode == "all" else "(" + glue.join(map(re.escape, words)) + ")"


def matching_lines(docs: DataFrame, words: list[str], mode: str = "any", grep: str | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Lines of documents by mode, and by a further regular expression; mode first gives one line for each document."""
    lines = numbered_lines(docs, id_col, text_col).where(F.col("line").rlike(line_pattern(words, mode)))
    if grep is not None:
        lines = lines.where(F.col("line").rlike(grep))
    if mode == "first":
        return lines.groupBy("id").agg(F.min(F.struct("line_no", "line")).alias("l")).select("id", "l.line_no", "l.line")
    return lines


def summary(nwords: Column, words: list[str], length: int) -> Column:
    """For each word that occurs: `length` normal words from its first occurrence on, joined by blanks; parts by ' ... '."""
    parts = [F.when(F.array_position(nwords, w) > 0, F.array_join(F.slice(nwords, F.greatest(F.array_position(nwords, w), F.lit(1)).cast("int"), length), " ")) for w in words]
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), " ... ")


def counts(results: DataFrame, docs: DataFrame, pattern: str) -> DataFrame:
    """shown (uri matches), scanned (results with a document), total (documents), in one row."""
    joined = results.select("id").join(docs.select("id", "uri"), "id")
    r = joined.agg(F.count_if(F.col("uri").rlike(pattern)).alias("shown"), F.count("*").alias("scanned"))
    return r.join(F.broadcast(docs.agg(F.count("*").alias("total"))))  # one row each
