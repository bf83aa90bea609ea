"""Exact duplicate removal: 128-bit content hash, byte comparison inside groups, smallest stable id. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistrata.llm.common import durable, stripped

_NO_ID = 1 << 63  # ranks behind every long id


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes agree once blanks, tabs and line ends are deleted. Of equal texts the row with the most
    code points in the original text stays, then the one with the smallest id. Ids must be whole numbers: text that is none
    counts as a null id.

    Plan: the rows are grouped by (content hash, normalised text), so that bytes are compared inside each hash group; partial
    aggregation leaves at most one row per distinct text and map task, however large a group of copies is. The decisions, a
    few dozen bytes for each hash, are written to the shared folder and joined back by hash; adaptive execution splits the
    document side of a hot hash. Only where a hash holds two different texts (a collision) do rows join by their bytes too.

    Defined results: a null text is empty; empty texts form one group; a null id ranks last and can only stay (keep_id null)
    in a group that has no other id of as long a text; rows repeating the id that stays are all kept; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).try_cast("long").alias("_id"), stripped(text).alias("_norm"), F.char_length(text).cast("long").alias("_n"))
    rows = rows.withColumn("_h", F.unhex(content_hash(F.col("_norm"))))
    # most code points, then smallest id, as one number: a mutable aggregation buffer, so hash aggregation applies
    rank = F.col("_n").cast("decimal(38,0)") * _whole(1 << 65) - F.coalesce(F.col("_id").cast("decimal(20,0)"), _whole(_NO_ID))
    rows = rows.withColumn("_rank", rank.cast("decimal(38,0)"))
    texts = rows.groupBy("_h", "_norm").agg(F.count("*").alias("_size"), F.max("_rank").alias("_best"))
    by_hash = texts.groupBy("_h").agg(F.count("*").alias("_texts"), F.sum("_size").alias("_size"), F.max("_best").alias("_best"))
    decided = durable(by_hash, "exact-dedup")
    light = rows.select("_id", "_h", F.sha2("_norm", 256).alias("_sha"))
    out = light.join(decided.where("_texts = 1"), "_h")
    out = out.select("_id", "_sha", "_size", "_best")
    if not decided.where("_texts > 1").isEmpty():
        collided = decided.where("_texts > 1").select("_h")
        pairs = rows.join(collided, "_h", "left_semi")
        classes = pairs.groupBy("_h", "_norm").agg(F.count("*").alias("_size"), F.max("_rank").alias("_best"))
        again = pairs.select("_id", "_h", "_norm").join(classes, ["_h", "_norm"])
        out = out.unionByName(again.select("_id", F.sha2("_norm", 256).alias("_sha"), "_size", "_best"))
    found = _whole(_NO_ID) - (F.col("_best") + _whole(_NO_ID)) % _whole(1 << 65)
    keep = F.when(found < _whole(_NO_ID), found.cast("long"))
    out = out.withColumn("_keep", keep)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
