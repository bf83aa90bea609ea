"""What the query modules share: tables, and text analysis spelled out in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexistrata.functions.text import STANDARD
from lexistrata.sources.storage import spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PATTERN, _DELIM, _GLUE = quoted(STANDARD.pattern), quoted("^" + STANDARD.delimiter_class), quoted(STANDARD.glue)


def normal_sql(token: str) -> str:
    return f"CASE WHEN regexp_matches({token}, {_DELIM}) THEN '' ELSE rtrim(translate(substr({token}, 1, 49), {ALPHABET}), {_GLUE}) END"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {_PATTERN})"


#: CTEs norm(id, pos, asis, word, wnum) and postings(word, id, score) over documents.
NORM = f"""toks AS (SELECT doc_id AS id, {tokens_sql('text')} AS w FROM documents),
words AS (SELECT id, len(w) AS wnum, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos FROM toks),
norm AS (SELECT id, pos, substr(tok, 1, 49) AS asis, {normal_sql('tok')} AS word, wnum FROM words)"""


def score_sql(tf: str, first: str, wnum: str) -> str:
    return f"CAST(trunc(({tf} * 10000 + CASE WHEN {first} <= CAST(trunc({wnum} * 0.1::DOUBLE) AS INT) THEN 5000 ELSE 0 END) / greatest(8.0::DOUBLE, pow(CASE WHEN {wnum} <= 1 THEN 0 ELSE ceil(10 * ln({wnum})) / 10 END, 3) / 8.0)) AS INT)"


POSTINGS = NORM + f""",
tf AS (SELECT word, id, count(*) AS tf, min(pos) AS first_pos, max(wnum) AS wnum FROM norm WHERE word <> '' GROUP BY word, id),
postings AS (SELECT word, id, {score_sql('tf', 'first_pos', 'wnum')} AS score FROM tf)"""


def log_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 1 THEN 0 ELSE ceil(10 * ln({x})) / 10 END"


#: CTE term(word, id, score): postings weighed by document frequency, as queries use them.
TERM = POSTINGS + f""",
dfs AS (SELECT word, count(*) AS df FROM postings GROUP BY word),
term AS (SELECT word, id, CAST(trunc(score / greatest(4.0::DOUBLE, pow({log_sql('df')}, 2) / 4.0)) AS BIGINT) AS score FROM postings JOIN dfs USING (word))"""
