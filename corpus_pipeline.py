"""A corpus cleaning pipeline: each stage's documents are written as Parquet and read again as the next one's.

Stages that filter keep all columns of their rows, whatever these are. Defined results: null texts are empty (the language stage
rejects them, as texts without a letter); rows that repeat a doc_id are one document, and rows without one are taken together by
the deduplicating stages: they stay if any of them is the one that its group keeps; empty tables stay empty."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistrata.llm.common import durable, table
from lexistrata.llm.exact_dedup import exact_dedup
from lexistrata.llm.langid import keep_identified, train_languages
from lexistrata.llm.near_dedup import near_components
from lexistrata.llm.packing import packed_documents
from lexistrata.llm.quality import keep_quality, train_quality

#: A document whose language is this unsure is rejected; texts in two languages in equal parts reach about 0.5.
LEAST_LANGUAGE_SCORE = 0.35


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1 stay. It is fitted on the labelled ones among docs."""
    return keep_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language determined well enough stay."""
    return keep_identified(docs, train_languages(docs), LEAST_LANGUAGE_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept_doc_id"))
    return docs.join(kept, docs.doc_id.eqNullSafe(F.col("_kept_doc_id")), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the one with the smallest id.

    Candidates are the SimHash operator's links and, beyond what its 3 bits reach, those of minhash bands; README has the figures."""
    kept = near_components(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept_doc_id"))
    return docs.join(kept, docs.doc_id.eqNullSafe(F.col("_kept_doc_id")), "left_semi")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, as pieces of packed sequences."""
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("language id", keep_known_language),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("best-fit packing", pack_documents),
]

#: The stages score texts with trained models, which SQL cannot express; tests/llm hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
