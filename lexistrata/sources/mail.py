"""Mailboxes: mbox files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistrata.functions.markup import mime_break


def mbox(spark: SparkSession, path: str) -> DataFrame:
    """headers (map, lower-case names) and body of every message of the mbox files below path.

    Files are split at the lines that begin a message, by the text source, so a large mailbox is read by many tasks. `>From` at
    the begin of a line loses one `>`; line ends at a body's end go."""
    raw = spark.read.text(path, lineSep="\nFrom ")
    message = F.regexp_replace(F.regexp_replace("value", r"\A[^\n]*\n", ""), r"(?m)^>(>*From )", "$1")
    parsed = raw.where(F.trim("value") != "").select(mime_break(message).alias("m"))
    return parsed.select("m.headers", F.regexp_replace("m.body", r"\n+\z", "").alias("body"))


def mbox_row(headers: Column, body: Column) -> Column:
    """One message as a row for write.text: headers are `Name: value` lines."""
    quoted = F.regexp_replace(body, r"(?m)^(>*From )", ">$1")
    return F.concat(F.lit("From - \n"), headers, F.lit("\n\n"), quoted, F.lit("\n"))
