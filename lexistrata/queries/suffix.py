"""Suffix array and delta queries over benchmark texts and document pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.operators import delta, suffix
from lexistrata.queries.changes import SNAPSHOTS, snapshot_a, snapshot_b
from lexistrata.queries.common import Query, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def texts(spark, d) -> DataFrame:
    return table(spark, d, "benchmark")


_SUFFIXES = "s AS (SELECT item_id AS id, unnest(range(0, length(text) + 1)) AS pos, text FROM benchmark), r AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY substr(text, pos + 1)) - 1 AS INT) AS rank, CAST(pos AS INT) AS pos, text FROM s)"


@query("suffix_array", f"WITH {_SUFFIXES} SELECT id, rank, pos FROM r")
def suffix_array(spark, d):
    return suffix.suffix_ranks(texts(spark, d), "item_id", "text")


@query("suffix_array_roundtrip", f"WITH {_SUFFIXES} SELECT id, string_agg(pos, ',' ORDER BY rank) AS positions FROM r GROUP BY id")
def suffix_array_roundtrip(spark, d):
    """Kept as one array for each text: as many numbers as the text has characters."""
    ranks = suffix.suffix_ranks(texts(spark, d), "item_id", "text")
    kept = ranks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "pos"))).getField("pos").alias("a"))
    return kept.select("id", F.array_join(F.col("a").cast("array<string>"), ",").alias("positions"))


@query("suffix_start", f"WITH {_SUFFIXES} SELECT id, rank AS start FROM r WHERE pos = 0")
def suffix_start(spark, d):
    return suffix.suffix_ranks(texts(spark, d), "item_id", "text").where("pos = 0").select("id", F.col("rank").alias("start"))


@query("char_positions", f"WITH {_SUFFIXES} SELECT id, rank, pos FROM r WHERE substr(text, pos + 1, 1) = 'e'")
def char_positions(spark, d):
    ranks = suffix.suffix_ranks(texts(spark, d), "item_id", "text").join(texts(spark, d).select(F.col("item_id").alias("id"), "text"), "id")
    return ranks.where("substring(text, pos + 1, 1) = 'e'").select("id", "rank", "pos")


@query("lcp_array", f"WITH {_SUFFIXES}, p AS (SELECT id, rank, pos, substr(text, pos + 1) AS a, lag(substr(text, pos + 1)) OVER (PARTITION BY id ORDER BY rank) AS b FROM r) SELECT id, rank, pos, CASE WHEN b IS NULL THEN 0 ELSE CAST((SELECT coalesce(max(n), 0) FROM unnest(range(1, least(length(a), length(b)) + 1)) t(n) WHERE a[1:n] = b[1:n]) AS INT) END AS lcp FROM p")
def lcp_array(spark, d):
    return suffix.lcp(texts(spark, d), "item_id", "text")


@query("substr_all_positions", "SELECT doc_id AS id, array_to_string([i for i in range(0, length(text) - 1) if substr(text, i + 1, 3) = 'the'], ',') AS positions FROM documents WHERE contains(text, 'the')")
def substr_all_positions(spark, d):
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("the")))
    return docs.select(F.col("doc_id").alias("id"), F.array_join(suffix.all_positions(F.col("text"), F.lit("the")).cast("array<string>"), ",").alias("positions"))


@query("bwt", f"WITH {_SUFFIXES} SELECT id, CAST(max(rank) FILTER (WHERE pos = 0) AS INT) AS start, string_agg(substr(text, pos, 1), '' ORDER BY rank) FILTER (WHERE pos > 0) AS bwt FROM r GROUP BY id")
def bwt(spark, d):
    return suffix.bwt(texts(spark, d), "item_id", "text")


def neighbours(spark, d) -> DataFrame:
    """Each text (s) with the one after it (t)."""
    a = texts(spark, d).select(F.col("item_id").alias("id"), F.col("text").alias("s"))
    return a.join(texts(spark, d).select((F.col("item_id") - 1).alias("id"), F.col("text").alias("t")), "id")


_NEXT = "p AS (SELECT a.item_id AS id, a.text AS s, b.text AS t FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"
_FIRST = "CAST(CASE WHEN length = 0 THEN 0 ELSE strpos(s, t[1:length]) - 1 END AS INT) AS start, length"


@query("longest_match", f"WITH {_NEXT}, q AS (SELECT id, s, substr(t, 11) AS t FROM p), m AS (SELECT id, s, t, CAST((SELECT coalesce(max(n), 0) FROM unnest(range(1, length(t) + 1)) x(n) WHERE contains(s, t[1:n])) AS INT) AS length FROM q) SELECT id, {_FIRST} FROM m")
def longest_match(spark, d):
    return suffix.matches(neighbours(spark, d), "s", "t", 10).select("id", "start", "length")


@query("longest_nonmatch", f"WITH {_NEXT}, k AS (SELECT id, s, t, (SELECT coalesce(min(i), length(t)) FROM unnest(range(0, length(t) - 3)) x(i) WHERE contains(s, t[i + 1:i + 4])) AS k FROM p), q AS (SELECT id, s, CAST(k AS INT) AS nonmatch, substr(t, k + 1) AS t FROM k), m AS (SELECT id, s, t, nonmatch, CAST((SELECT coalesce(max(n), 0) FROM unnest(range(4, length(t) + 1)) x(n) WHERE contains(s, t[1:n])) AS INT) AS length FROM q) SELECT id, nonmatch, {_FIRST} FROM m")
def longest_nonmatch(spark, d):
    """Each text's successor against it: characters without a match over 3 characters, then the match."""
    return suffix.matches(neighbours(spark, d), "s", "t", 0, 3).select("id", "nonmatch", "start", "length")


# --- deltas of documents edited between the snapshots: an edited text is the old one and 7 bytes more. So its delta is known: a
# match of the whole source and 7 bytes inserted, or, where the source is too short to count as a match, one insert of all ---

_PAIRS = f"WITH {SNAPSHOTS}, pairs AS (SELECT path, a.content AS source, b.content AS target, strlen(a.content) AS n, strlen(a.content) > {delta.SHORT_MATCH} AS long FROM snapshot_a a JOIN snapshot_b b USING (path) WHERE a.mtime <> b.mtime)"
_LE32 = "lower(format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', ({0}) & 255, (({0}) >> 8) & 255, (({0}) >> 16) & 255, (({0}) >> 24) & 255))"


def pairs(spark, d) -> DataFrame:
    a = snapshot_a(spark, d).select("path", F.col("content").alias("source"), F.col("mtime").alias("ma"))
    b = snapshot_b(spark, d).select("path", F.col("content").alias("target"), F.col("mtime").alias("mb"))
    return a.join(b, "path").where("ma <> mb").select("path", "source", "target")


def deltas(spark, d) -> DataFrame:
    return delta.make_deltas(pairs(spark, d))


@query("delta_make", f"{_PAIRS} SELECT path, CASE WHEN long THEN 'M0+' || n || ' I7' ELSE 'I' || n + 7 END AS ops FROM pairs")
def delta_make(spark, d):
    one = lambda o: F.when(o["op"] == delta.MATCH, F.concat(F.lit("M"), o["start"].cast("string"), F.lit("+"), o["length"].cast("string"))).otherwise(F.concat(F.lit("I"), F.octet_length(o["data"]).cast("string")))
    return deltas(spark, d).select("path", F.array_join(F.transform("ops", one), " ").alias("ops"))


@query("delta_apply", f"{_PAIRS} SELECT path, n + 7 AS bytes, md5(target) AS digest, CASE WHEN long THEN 7 ELSE n + 7 END AS carried FROM pairs")
def delta_apply(spark, d):
    """Targets from sources and deltas alone, and the bytes that the deltas carry."""
    made = deltas(spark, d).select("path", "source", "ops").withColumn("t", delta.apply_deltas(F.col("source"), F.col("ops")))
    return made.select("path", F.octet_length("t").cast("long").alias("bytes"), F.md5("t").alias("digest"), F.col("ops").alias("o")).select("path", "bytes", "digest", delta.delta_stats(F.col("o"))["insert_total"].alias("carried"))


@query("delta_codec_roundtrip", f"{_PAIRS} SELECT path, CASE WHEN long THEN '0100000000' || {_LE32.format('n')} || '0007000000' || lower(hex(' EDITED')) ELSE '00' || {_LE32.format('n + 7')} || lower(hex(target)) END AS record, md5(target) AS digest FROM pairs")
def delta_codec_roundtrip(spark, d):
    """Operations as little-endian records, and what these apply to."""
    coded = deltas(spark, d).select("path", "source", delta.encode_ops("ops").alias("c"))
    return coded.select("path", F.lower(F.hex("c")).alias("record"), F.md5(delta.apply_deltas(F.col("source"), delta.decode_ops("c"))).alias("digest"))


_EVENTS = "SELECT path, 0 AS n, 'MATCH' AS op, 0 AS start, CAST(n AS INT) AS length FROM pairs WHERE long UNION ALL SELECT path, 1, 'INSERT', 0, 7 FROM pairs WHERE long UNION ALL SELECT path, 0, 'INSERT', 0, CAST(n + 7 AS INT) FROM pairs WHERE NOT long"


@query("delta_log", f"{_PAIRS} {_EVENTS}")
def delta_log(spark, d):
    """Operations one by one, by expressions."""
    ops = deltas(spark, d).select("path", F.posexplode("ops").alias("n", "o"))
    return ops.select("path", "n", F.when(F.col("o.op") == delta.MATCH, "MATCH").otherwise("INSERT").alias("op"), "o.start", "o.length")


@query("delta_events", f"{_PAIRS} {_EVENTS}")
def delta_events(spark, d):
    """Operations one by one, by the table function over binary deltas."""
    coded = deltas(spark, d).select("path", delta.encode_ops("ops").alias("c"))
    spark.udtf.register("delta_events", delta.Events)
    return spark.sql("SELECT path, e.n, e.op, e.start, e.length FROM {coded}, LATERAL delta_events(c) e", coded=coded)


@query("delta_stats", f"{_PAIRS} SELECT path, CAST(CASE WHEN long THEN 1 ELSE 0 END AS BIGINT) AS match_count, CASE WHEN long THEN n ELSE 0 END AS match_total, CAST(1 AS BIGINT) AS insert_count, CASE WHEN long THEN 7 ELSE n + 7 END AS insert_total FROM pairs")
def delta_stats(spark, d):
    return deltas(spark, d).select("path", delta.delta_stats(F.col("ops")).alias("s")).select("path", "s.*")


@query("delta_nochange", f"WITH {SNAPSHOTS} SELECT path, a.content = b.content AS same FROM snapshot_a a JOIN snapshot_b b USING (path) WHERE a.content <> ''")
def delta_nochange(spark, d):
    a, b = (f(spark, d).select("path", F.col("content").alias(c)) for f, c in ((snapshot_a, "source"), (snapshot_b, "target")))
    made = delta.make_deltas(a.join(b, "path").where("source <> ''"), least=0)
    return made.select("path", delta.no_change(F.col("source"), F.col("target"), F.col("ops")).alias("same"))
