"""URL filters: host-suffix and path-prefix expressions, hash-prefix equi-join, full digest and precedence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that rules and expressions are joined on: 32 bits.
PREFIX = 8
RULE_SCHEMA = "host string, path string, verdict string"


def _clean_host(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end.

    Both are empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return _clean_host(host), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", keys: tuple[str, ...] = ()) -> DataFrame:
    """The key columns of every row with host, path, rule (host and path, else null) and verdict.

    A rule (host, path, verdict) fits its host and every subdomain of it where the url's path starts with the rule's path. The
    longest rule wins by the characters of host and path together; then the one with the longer host; then block.

    Plan: the distinct (host, path) pairs, which a hot url reaches as one row, expand into host suffixes (cut at dots) and
    path prefixes, only of the numbers of labels and the lengths that rules have. Expressions meet rules by a 32-bit digest prefix in an equi-join;
    the full digest decides. The best rule of a pair is an aggregate over its few matches and is joined back to the rows. Both
    joins are ones that adaptive execution splits where a key is hot, and Spark broadcasts a side only below its own threshold.

    Defined results: a null url, or one without `://`, has an empty host and path, no rule and the default verdict; repeated
    rows stay repeated; an empty rule table gives the default everywhere; null parts of a rule count as empty, and a rule with
    an empty host fits nothing; an empty url table gives no rows; other columns than the keys are ignored.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = urls.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], host.alias("_host"), path.alias("_path"))
    blank = F.lit("")
    ruled = rules.select(_clean_host(F.coalesce("host", blank)).alias("_rh"), F.coalesce("path", blank).alias("_rp"), F.col("verdict").alias("_rv"))
    ruled = ruled.where("_rh <> ''").groupBy("_rh", "_rp").agg(F.max(F.col("_rv") == "block").alias("_block"))
    labels = F.char_length("_rh") - F.char_length(F.replace("_rh", F.lit("."), F.lit(""))) + 1
    sizes = ruled.agg(F.sort_array(F.collect_set(F.char_length("_rp"))).alias("_sizes"), F.sort_array(F.collect_set(labels)).alias("_labels")).first()  # one row; a few hundred numbers at most
    ruled = ruled.select("*", _digest(F.col("_rh"), F.col("_rp")).alias("_rd"), (F.char_length("_rh") + F.char_length("_rp")).alias("_rn"))
    ruled = ruled.withColumn("_short", F.substring("_rd", 1, PREFIX))

    pairs = rows.where("_host <> ''").select("_host", "_path").distinct()
    dots = F.char_length("_host") - F.char_length(F.replace("_host", F.lit("."), F.lit("")))
    suffixes = F.array(*[F.when(dots >= n - 1, F.substring_index("_host", ".", -n)) for n in sizes["_labels"] or [1]])
    suffixes = F.filter(suffixes, lambda h: h.isNotNull())
    found = sizes["_sizes"] or [0]
    prefixes = F.filter(F.transform(F.array(*[F.lit(int(n)) for n in found]), lambda n: F.when(n <= F.char_length("_path"), F.substr(F.col("_path"), F.lit(1), n))), lambda p: p.isNotNull())
    wide = pairs.select("_host", "_path", F.explode(suffixes).alias("_h"), prefixes.alias("_ps")).select("_host", "_path", "_h", F.explode("_ps").alias("_p"))
    wide = wide.select("_host", "_path", _digest(F.col("_h"), F.col("_p")).alias("_d")).withColumn("_short", F.substring("_d", 1, PREFIX))
    hits = wide.join(ruled, "_short").where("_d = _rd")
    best = hits.groupBy("_host", "_path").agg(F.max(F.struct("_rn", F.char_length("_rh").alias("_hn"), "_block", "_rh", "_rp")).alias("_b"))
    best = best.select("_host", "_path", F.concat("_b._rh", "_b._rp").alias("rule"), F.when(F.col("_b._block"), "block").otherwise("allow").alias("_v"))
    out = rows.join(best, ["_host", "_path"], "left")
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("_v", F.lit(default)).alias("verdict"))
