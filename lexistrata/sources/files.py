"""Trees of files, lines and large binary values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistrata.operators.changes import visible


def excluding(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """Paths that none of the regular expressions finds."""
    return paths.where(~F.col("path").rlike("|".join(f"(?:{p})" for p in patterns))) if patterns else paths


def tree(spark: SparkSession, root: str, content: bool = True, excludes: list[str] | None = None) -> DataFrame:
    """path (./ and what is below root), size, mtime (seconds) and content of every visible file that no pattern excludes.

    Names are listed by the file source; without content only the listing is read, as columns are pruned before the files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = full.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(full).toString().rstrip("/")
    path = F.concat(F.lit("."), F.expr(f"substring(path, {len(base) + 1})"))
    rows = df.select(path.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), *(["content"] if content else []))
    return excluding(visible(rows), excludes or [])


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The tree as operators.changes takes it: path, content (text), mtime."""
    return tree(spark, root).select("path", F.decode("content", "utf-8").alias("content"), "mtime")


def find_up(spark: SparkSession, start: str, name: str) -> str | None:
    """The nearest folder at or above `start` that holds `name`; None if there is none up to the root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(start)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    while path is not None:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, name)):
            return path.toString()
        path = path.getParent()
    return None
