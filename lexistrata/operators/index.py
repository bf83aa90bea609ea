"""The scored inverted index: documents, postings, maintenance, keywords.

documents: id, uri, attrs map<string,string>, nwords array<string> (normal forms), awords array<string> (as-is forms).
postings: word, id, score. Every operator returns new DataFrames; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistrata.functions.text import STANDARD, CharClasses, score_log


# Fixed values of the scores: an occurrence, one in the first tenth, the least length term, and what the terms divide by.
OCCURRENCE, EARLY, LEAST_TERM, TERM_DIVISOR = 10000, 5000, 8.0, 8.0
#: Fixed value: candidates for each keyword that is wanted.
KEYWORD_POOL = 1.75


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame


def analyze(df: DataFrame, id_col: str, text_col: str, classes: CharClasses = STANDARD) -> DataFrame:
    """id, pos (from 0), asis, word (the normal form, empty for delimiters), wnum (tokens of the text). No shuffle."""
    toks = df.select(F.col(id_col).alias("id"), classes.tokens(F.col(text_col)).alias("t"))
    rows = toks.select("id", F.size("t").alias("wnum"), F.posexplode("t").alias("pos", "tok"))
    return rows.select("id", "pos", classes.as_is(F.col("tok")).alias("asis"), classes.normal(F.col("tok")).alias("word"), "wnum")


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """id, word, tf, first_pos, wnum. A text's tokens come from one task, so partial aggregation already gives the final rows
    and only distinct (word, id) pairs are shuffled."""
    return tokens.where("word <> ''").groupBy("word", "id").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"), F.max("wnum").alias("wnum"))


def posting_score(tf: Column, first_pos: Column, wnum: Column) -> Column:
    """10000 for each occurrence and 5000 more for one in the first tenth, over a length term of 8 at least; cut to whole."""
    early = F.when(first_pos <= (wnum * F.lit(0.1)).cast("int"), EARLY).otherwise(0)
    return ((tf * OCCURRENCE + early) / length_term(wnum)).cast("int")


def length_term(x: Column) -> Column:
    return F.greatest(F.lit(LEAST_TERM), F.pow(score_log(x), 3.0) / TERM_DIVISOR)


def postings(df: DataFrame, id_col: str, text_col: str, classes: CharClasses = STANDARD) -> DataFrame:
    """word, id, score of every word of every text."""
    tf = term_frequencies(analyze(df, id_col, text_col, classes))
    return tf.select("word", "id", posting_score(F.col("tf"), F.col("first_pos"), F.col("wnum")).alias("score"))


def postings_of_words(docs: DataFrame) -> DataFrame:
    """Postings from the stored word lists of documents."""
    rows = docs.select("id", F.size("nwords").alias("wnum"), F.posexplode("nwords").alias("pos", "word"))
    tf = term_frequencies(rows)
    return tf.select("word", "id", posting_score(F.col("tf"), F.col("first_pos"), F.col("wnum")).alias("score"))


def documents(df: DataFrame, id_col: str, uri: Column, text_col: str, attrs: Column | None = None, wmax: int = -1, classes: CharClasses = STANDARD) -> DataFrame:
    """Documents with their words; wmax (-1: all) limits the stored lists, not what is indexed."""
    toks = classes.tokens(F.col(text_col))
    toks = toks if wmax < 0 else F.slice(toks, 1, wmax)
    none = F.create_map().cast("map<string,string>")
    out = df.select(F.col(id_col).alias("id"), uri.alias("uri"), (none if attrs is None else attrs).alias("attrs"), toks.alias("t"))
    return out.select("id", "uri", "attrs", F.transform("t", classes.normal).alias("nwords"), F.transform("t", classes.as_is).alias("awords"))


def build(df: DataFrame, id_col: str, uri: Column, text_col: str, attrs: Column | None = None, wmax: int = -1) -> Index:
    return Index(documents(df, id_col, uri, text_col, attrs, wmax), postings(df, id_col, text_col))


def put(index: Index, new: DataFrame, over: bool = True, order: str | None = None) -> Index:
    """Upsert: new has uri, attrs, nwords, awords. Known uris are replaced (over) or left as they are; new ids follow the
    largest id. Replaced ids leave their postings until purge. Of an uri that comes more than once, the row with the largest
    `order` is put (the smallest where known uris stay); without a column of that kind, one of them.

    Ids come from ranks inside hash buckets of the uri plus the buckets' offsets, so no single task sorts all new rows."""
    pick = F.max_by if over else F.min_by
    new = new.groupBy("uri").agg(pick(F.struct("attrs", "nwords", "awords"), F.col(order) if order else F.size("nwords")).alias("d")).select("uri", "d.*")
    known = index.docs.select("uri")
    fresh = new if over else new.join(known, "uri", "left_anti")
    old = index.docs.join(fresh.select("uri"), "uri", "left_anti") if over else index.docs
    ranked = fresh.withColumn("_b", F.pmod(F.xxhash64("uri"), F.lit(1024)))
    counts = ranked.groupBy("_b").agg(F.count("*").alias("_n"))  # 1024 rows at most
    offsets = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("_off", F.lit(0)).alias("_off"))
    top = index.docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("uri")))
    added = ranked.join(F.broadcast(offsets), "_b").join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_off") + F.col("_r"))
    added = added.select("id", "uri", "attrs", "nwords", "awords")
    return Index(old.select("id", "uri", "attrs", "nwords", "awords").unionByName(added), index.postings.unionByName(postings_of_words(added)))


def delete(index: Index, uris: DataFrame) -> Index:
    """Documents of the given uris go; their postings stay until purge."""
    return Index(index.docs.join(uris.select("uri"), "uri", "left_anti").select(index.docs.columns), index.postings)


def purge(index: Index) -> Index:
    """Postings without a document go. Only the ids of documents are shuffled with the postings."""
    return Index(index.docs, index.postings.join(index.docs.select("id"), "id", "left_semi").select("word", "id", "score"))


def optimize(index: Index, partitions: int | None = None) -> Index:
    """Purge, then lay postings out by word with the best scores first: files' statistics then prune look-ups of a word."""
    return Index(index.docs, ranged_by_word(purge(index).postings, partitions))


def ranged_by_word(posts: DataFrame, partitions: int | None = None) -> DataFrame:
    laid = posts.repartitionByRange(partitions, "word", "id") if partitions else posts.repartitionByRange("word", "id")
    return laid.sortWithinPartitions("word", F.desc("score"), "id")


def merge(catalogs: list[Index], purged: bool = False) -> Index:
    """One index of several: the ids of each are moved beyond the largest of those before; of equal uris the first catalog's
    document stays, and the others' postings until purge, or go with `purged`: only the ids that lost, few against the postings,
    are joined with these."""
    docs, posts, tops = None, None, None
    for k, c in enumerate(catalogs):
        top = c.docs.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top")).withColumn("k", F.lit(k))
        tops = top if tops is None else tops.unionByName(top)
    bases = tops.withColumn("base", F.coalesce(F.sum("top").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("k", "base")
    for k, c in enumerate(catalogs):
        d, p = c.docs.withColumn("k", F.lit(k)), c.postings.withColumn("k", F.lit(k))
        docs, posts = (d, p) if docs is None else (docs.unionByName(d), posts.unionByName(p))
    first = docs.groupBy("uri").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1")
    lost = docs.select("id", "uri", "k").join(first, "uri").where("k <> first").select("k", "id")
    docs, posts = docs.join(lost, ["k", "id"], "left_anti"), posts.join(lost, ["k", "id"], "left_anti") if purged else posts
    moved = F.col("id") + F.col("base")
    docs = docs.join(F.broadcast(bases), "k").select(moved.alias("id"), "uri", "attrs", "nwords", "awords")  # one row for each catalog
    return Index(docs, posts.join(F.broadcast(bases), "k").select("word", moved.alias("id"), "score"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("word").agg(F.count("*").alias("df"))


def search(posts: DataFrame, word: str, limit: int = -1) -> DataFrame:
    """Postings of exactly this word, best score first, ties by id; the filter reaches the tokens below the aggregation."""
    found = posts.where(F.col("word") == word).select("id", "score").orderBy(F.desc("score"), "id")
    return found if limit < 0 else found.limit(limit)


def keywords(docs: DataFrame, most: int, df_table: DataFrame | None = None) -> DataFrame:
    """id, rank, word, num: the words with the largest weights of each document.

    A weight is 10000 for each occurrence in the stored words; the floor(1.75 most) best (weight, then longer, then bytes)
    are kept, divided by the document frequency's term of 8 at least (with df_table), and ranked again."""
    pool = _pools(docs, int(KEYWORD_POOL * most))
    by_doc = Window.partitionBy("id").orderBy(F.desc("num"), F.desc(F.octet_length("word")), F.col("word"))
    if df_table is not None:
        d = length_term(F.coalesce("df", F.lit(0)))
        pool = pool.join(df_table, "word", "left").withColumn("num", F.when(F.col("df").isNull(), F.lit(0)).otherwise((F.col("num") / d).cast("long"))).drop("df")
    return pool.withColumn("rank", F.row_number().over(by_doc)).where(F.col("rank") <= most).select("id", "rank", "word", "num")


def _pools(docs: DataFrame, size: int) -> DataFrame:
    """id, word, num: the `size` heaviest words of each document, counted and chosen in the task that reads it. A batch's words are
    numbered once and counted as pairs of numbers, so no word is handled by itself and none but the chosen are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().dictionary_encode()
            names = flat.dictionary.to_pylist()
            place = np.empty(len(names), np.int64)  # longer words first, then by bytes
            place[sorted(range(len(names)), key=lambda i: (-len(names[i].encode()), names[i].encode()))] = np.arange(len(names))
            codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, n = np.unique(np.repeat(np.arange(b.num_rows), sizes) * max(1, len(names)) + codes, return_counts=True)
            row, code = np.divmod(pairs, max(1, len(names)))
            named = np.array([w != "" for w in names], bool)[code]
            row, code, n = row[named], code[named], n[named]
            order = np.lexsort((place[code], -n, row))
            row, code, n = row[order], code[order], n[order]
            chosen = np.arange(len(row)) - np.searchsorted(row, row) < size
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[chosen])), flat.dictionary.take(pa.array(code[chosen])), pa.array(n[chosen] * OCCURRENCE)], ["id", "word", "num"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "nwords").mapInArrow(run, f"id {kind}, word string, num long")


def similarity(keys: DataFrame, least: float = 0.5) -> DataFrame:
    """Cosine of keyword vectors: a, b (a < b), dot, cosine of the pairs of documents that reach `least`.

    keys is keywords' result, a few rows for each document. Words are ordered by how few documents have them; a vector whose
    words from some place on have less than `least` of its length cannot reach it by these alone, so only the words before are
    joined: a word that many documents have stays out of the join unless it carries a vector. Candidates are verified whole."""
    common = keys.groupBy("word").agg(F.count("*").alias("df"))
    entry = F.struct("df", "word", F.col("num").cast("double").alias("num"))
    vectors = keys.join(common, "word").groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("v"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, e: a + e["num"] * e["num"])
    vectors = vectors.withColumn("x", F.sqrt(square(F.col("v")))).where("x > 0")
    begins = F.filter(F.sequence(F.lit(1), F.size("v")), lambda i: F.sqrt(square(F.slice("v", i, F.size("v")))) >= F.lit(least - 1e-9) * F.col("x"))
    heads = vectors.select("id", F.explode(F.transform(begins, lambda i: F.element_at("v", i)["word"])).alias("word"))
    a, b = heads.withColumnRenamed("id", "a"), heads.withColumnRenamed("id", "b")
    pairs = a.join(b, "word").where("a < b").select("a", "b").distinct()
    va, vb = vectors.select(F.col("id").alias("a"), F.col("v").alias("p"), F.col("x").alias("xa")), vectors.select(F.col("id").alias("b"), F.map_from_entries(F.transform("v", lambda e: F.struct(e["word"], e["num"]))).alias("q"), F.col("x").alias("xb"))
    dot = F.aggregate("p", F.lit(0.0), lambda s, e: s + e["num"] * F.coalesce(F.try_element_at("q", e["word"]), F.lit(0.0)))
    out = pairs.join(va, "a").join(vb, "b").select("a", "b", dot.alias("dot"), (dot / (F.col("xa") * F.col("xb"))).alias("cosine"))
    return out.where(F.col("cosine") >= least - 1e-9).select("a", "b", F.col("dot").cast("long").alias("dot"), "cosine")


def stats(index: Index) -> DataFrame:
    """doc_count, word_count, posting_count, score_sum, max_id in one row."""
    p = index.postings.groupBy("word").agg(F.count("*").alias("n"), F.sum("score").alias("s")).agg(F.count("*").alias("word_count"), F.sum("n").alias("posting_count"), F.sum("s").alias("score_sum"))
    d = index.docs.agg(F.count("*").alias("doc_count"), F.max("id").alias("max_id"))
    return d.join(F.broadcast(p))  # one row each
