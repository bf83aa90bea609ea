"""Full-text search queries over documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistrata.functions.text import STANDARD, CharClasses
from lexistrata.functions.vectors import cosine, dot, norm
from lexistrata.operators import index as ix
from lexistrata.plans import boolean, find
from lexistrata.queries.common import ALPHABET, NORM, POSTINGS, TERM, Query, log_sql, normal_sql, quoted, table, tokens_sql
from lexistrata.sources import catalog, storage

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def posts_of(spark: SparkSession, d: str) -> DataFrame:
    return ix.postings(docs_of(spark, d), "doc_id", "text")


URI = "concat(coalesce(lang, ''), '/', doc_id)"


_ATTRS = "map('lang', lang, 'source', source)"


def index_of(spark: SparkSession, d: str, wmax: int = -1) -> ix.Index:
    """An index of the documents as they are."""
    return ix.build(docs_of(spark, d), "doc_id", F.expr(URI), "text", F.expr(_ATTRS), wmax)


def saved(spark: SparkSession, d: str, where: str = "true") -> ix.Index:
    """The saved catalog of the documents: made once, by the first query that opens it."""
    return catalog.opened(spark, f"{d} {where}", lambda path: catalog.index_texts(docs_of(spark, d).where(where), path, "doc_id", F.expr(URI), "text", F.expr(_ATTRS)))


def saved_posts(spark: SparkSession, d: str) -> DataFrame:
    return saved(spark, d).postings


# --- analysis and postings ---


@query("analyze_text", f"WITH {NORM} SELECT id, pos, asis, word, wnum FROM norm")
def analyze_text(spark, d):
    return ix.analyze(docs_of(spark, d), "doc_id", "text")


@query("break_text", f"WITH t AS (SELECT doc_id AS id, [x for x in {tokens_sql('text')} if len(x) <= 48] AS w FROM documents) SELECT id, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos, unnest(w) AS word FROM t")
def break_text(spark, d):
    return docs_of(spark, d).select(F.col("doc_id").alias("id"), F.posexplode(STANDARD.parts(F.col("text"))).alias("pos", "word"))


_ALL_DELIM = quoted(f"^{STANDARD.delimiter_class}*$")


@query("normalize_word", f"WITH w AS (SELECT DISTINCT unnest(string_split_regex(coalesce(text, ''), '[ \\n\\t]+')) AS word FROM documents) SELECT word, CASE WHEN regexp_matches(word, {_ALL_DELIM}) THEN '' ELSE rtrim(translate(word, {ALPHABET}), '+,-.:;@') END AS normal FROM w")
def normalize_word(spark, d):
    words = docs_of(spark, d).select(F.explode(F.split(F.coalesce("text", F.lit("")), "[ \\n\\t]+")).alias("word")).distinct()
    return words.select("word", STANDARD.normal_word(F.col("word")).alias("normal"))


_CUSTOM = CharClasses(space=" \n", delimiter="|#$%*&!", glue=".,;")


@query("analyze_custom_class", f"WITH t AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), {quoted(_CUSTOM.pattern)}) AS w FROM documents), x AS (SELECT id, unnest(w) AS tok FROM t), n AS (SELECT id, CASE WHEN regexp_matches(tok, {quoted('^' + _CUSTOM.delimiter_class)}) THEN '' ELSE rtrim(translate(substr(tok, 1, 49), {ALPHABET}), '.,;') END AS word FROM x) SELECT word, count(*) AS n, count(DISTINCT id) AS docs FROM n GROUP BY word")
def analyze_custom_class(spark, d):
    rows = ix.analyze(docs_of(spark, d), "doc_id", "text", _CUSTOM)
    return rows.groupBy("word", "id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("doc_add_words", f"WITH t AS (SELECT doc_id AS id, {tokens_sql('text')} AS a, {tokens_sql('source')} AS b FROM documents) SELECT id, array_to_string([{normal_sql('x')} for x in list_concat(a, b)], ' ') AS words FROM t")
def doc_add_words(spark, d):
    toks = F.concat(STANDARD.tokens(F.col("text")), STANDARD.tokens(F.col("source")))
    return docs_of(spark, d).select(F.col("doc_id").alias("id"), F.array_join(F.transform(toks, STANDARD.normal), " ").alias("words"))


@query("term_freq", f"WITH {POSTINGS} SELECT word, id, tf, first_pos, wnum FROM tf")
def term_freq(spark, d):
    return ix.term_frequencies(ix.analyze(docs_of(spark, d), "doc_id", "text"))


@query("postings", f"WITH {POSTINGS} SELECT word, id, score FROM postings")
def postings(spark, d):
    return posts_of(spark, d)


@query("postings_list", f"WITH {POSTINGS} SELECT word, CAST(floor(id / 65536) AS BIGINT) AS part, count(*) AS df, string_agg(id || ':' || score, ' ' ORDER BY score DESC, id) AS list FROM postings GROUP BY ALL")
def postings_list(spark, d):
    """Lists by word and range of 65,536 ids, best scores first, so the list of a word that every document has stays bounded."""
    part = F.floor(F.col("id") / 65536).alias("part")
    p = posts_of(spark, d).groupBy("word", part).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("l"))
    return p.select("word", "part", F.size("l").cast("long").alias("df"), F.array_join(F.transform("l", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), (-x["s"]).cast("string"))), " ").alias("list"))


@query("doc_freq", f"WITH {POSTINGS} SELECT word, count(*) AS df FROM postings GROUP BY word")
def doc_freq(spark, d):
    return ix.document_frequency(saved_posts(spark, d))


@query("index_stats", f"WITH {POSTINGS} SELECT (SELECT count(*) FROM documents) AS doc_count, (SELECT max(doc_id) FROM documents) AS max_id, count(DISTINCT word) AS word_count, count(*) AS posting_count, CAST(sum(score) AS BIGINT) AS score_sum FROM postings")
def index_stats(spark, d):
    return ix.stats(saved(spark, d))


@query("search_word", f"WITH {POSTINGS} SELECT id, score FROM postings WHERE word = 'the'")
def search_word(spark, d):
    return ix.search(saved_posts(spark, d), "the")


@query("search_topk", f"WITH {POSTINGS} SELECT id, score FROM postings WHERE word = 'the' ORDER BY score DESC, id LIMIT 25")
def search_topk(spark, d):
    return ix.search(saved_posts(spark, d), "the", 25)


@query("query_term", f"WITH {TERM} SELECT word, id, score FROM term WHERE word IN ('the', 'and', 'der', 'of')")
def query_term(spark, d):
    return boolean.weighed(saved_posts(spark, d), ["the", "and", "der", "of"])


# --- boolean queries: the oracle joins id sets, the engine aggregates once ---


def _w(word: str) -> str:
    return f"(SELECT id, score FROM term WHERE word = '{word}')"


def _and(a: str, b: str) -> str:
    return f"(SELECT x.id, x.score + y.score AS score FROM {a} x JOIN {b} y USING (id))"


def _or(a: str, b: str) -> str:
    return f"(SELECT id, CAST(sum(score) AS BIGINT) AS score FROM (SELECT * FROM {a} UNION ALL SELECT * FROM {b}) GROUP BY id)"


def _not(a: str, b: str) -> str:
    return f"(SELECT x.id, x.score FROM {a} x WHERE x.id NOT IN (SELECT id FROM {b}))"


_the, _and_, _of, _der, _zz = (_w(w) for w in ("the", "and", "of", "der", "qqzzqq"))
_BOOLEAN = {
    "query_and": ("the & and", _and(_the, _and_)),
    "query_or": ("the | der", _or(_the, _der)),
    "query_not": ("the ! of", _not(_the, _of)),
    "query_implicit_and": ("The and, OF", _and(_and(_the, _and_), _of)),
    "query_nested": ("the & (and | der) ! (of der)", _not(_and(_the, _or(_and_, _der)), _and(_of, _der))),
    "query_leftassoc": ("the | der & of", _and(_or(_the, _der), _of)),
    "query_missing_term": ("qqzzqq | the", _or(_zz, _the)),
    "query_ignored_tail": ("(the and) of", _and(_the, _and_)),
}


def _boolean(text: str) -> Query:
    return lambda spark, d: boolean.run(text, saved_posts(spark, d))[0]


for _name, (_text, _sql) in _BOOLEAN.items():
    query(_name, f"WITH {TERM} SELECT id, score FROM {_sql}")(_boolean(_text))

#: Query texts made of a document's language l and source s, and what the parser makes of them: tokens, errors, what it ignores.
_EDGES = [
    ("{l} {s}", "{l} & {s}", "", ""), ("{l} & {s} | c", "{l} & {s} | c", "", ""), ("{l} ! (b {s})", "{l} ! ( b & {s} )", "", ""), ("({l} b) {s}", "( {l} & b ) {s}", "", "{s}"),
    ("{l}) {s}", "{l} ) {s}", "", ") {s}"), ("! {s}", "! {s}", "invalid", "{s}"), ("-{l}", "-{l}", "invalid", ""), ('"{l} {s}"', '" {l} & {s} "', "invalid", '{l} & {s} "'),
    ('{l} "{s}', '{l} " & {s}', "", '" & {s}'), ("({l}", "( {l}", "open", ""), ("()", "( )", "invalid,open", ""), ("{l} &", "", "failed", ""), ("({s} &", "", "failed", ""), ("", "", "failed", ""),
]


def _made_sql(template: str) -> str:
    return "replace(replace(" + quoted(template) + ", '{l}', lang), '{s}', source)"


@query("query_errors", " UNION ALL ".join(f"SELECT DISTINCT {i} AS n, {_made_sql(q)} AS query, {_made_sql(t)} AS tokens, '{e}' AS errors, {_made_sql(g)} AS ignored FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL" for i, (q, t, e, g) in enumerate(_EDGES)))
def query_errors(spark, d):
    """What the parser reports, for queries made of every language and source."""

    @F.pandas_udf("tokens string, errors string, ignored string")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        short = {boolean.INVALID: "invalid", boolean.NOT_CLOSED: "open", boolean.UNBALANCED: "unbalanced"}

        def one(text: str) -> tuple[str, str, str]:
            try:
                q = boolean.parse(text)
            except boolean.QueryFailed:
                return "", "failed", ""
            return " ".join(q.tokens), ",".join(short[e] for e in q.errors), " ".join(q.ignored)

        return pd.DataFrame([one(t) for t in texts], columns=["tokens", "errors", "ignored"])

    pairs = docs_of(spark, d).select("lang", "source").where("lang is not null and source is not null").distinct()
    made = [F.struct(F.lit(i).alias("n"), F.replace(F.replace(F.lit(q), F.lit("{l}"), F.col("lang")), F.lit("{s}"), F.col("source")).alias("query")) for i, (q, *_) in enumerate(_EDGES)]
    rows = pairs.select(F.explode(F.array(*made)).alias("q")).select("q.n", "q.query").distinct()
    return rows.select("n", "query", parsed("query").alias("p")).select("n", "query", "p.*")


@query("result_page", f"WITH {TERM}, r AS (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) - 1 AS INT) AS rank FROM {_or(_the, _der)}) SELECT rank, id, score FROM r WHERE rank >= 10 AND rank < 30")
def result_page(spark, d):
    return boolean.page(boolean.compile(boolean.parse("the | der").tree, saved_posts(spark, d)), 10, 20)


# --- display ---

_FIND = "the & and ! of"
_FIND_SQL = _not(_and(_the, _and_), _of)


@query("find_flagship", f"WITH {TERM} SELECT id, score FROM {_FIND_SQL} ORDER BY score DESC, id LIMIT 20")
def find_flagship(spark, d):
    return boolean.run(_FIND, saved_posts(spark, d))[0].limit(20)


@query("find_files_regex", f"WITH {TERM} SELECT r.id, r.score, {URI} AS uri FROM {_or(_the, _der)} r JOIN documents ON doc_id = r.id WHERE regexp_matches({URI}, '^(en|de)/.*7$')")
def find_files_regex(spark, d):
    docs = docs_of(spark, d).select(F.col("doc_id").alias("id"), F.expr(URI).alias("uri"))
    return find.filter_uris(boolean.compile(boolean.parse("the | der").tree, saved_posts(spark, d)), docs, "^(en|de)/.*7$").select("id", "score", "uri")


_LINES = "lines AS (SELECT id, CAST(generate_subscripts(l, 1) AS INT) AS line_no, unnest(l) AS line FROM (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


def _line_query(words, mode, grep=None) -> Query:
    return lambda spark, d: find.matching_lines(docs_of(spark, d), words, mode, grep, "doc_id")


query("find_lines_any", f"WITH {_LINES} SELECT id, line_no, line FROM lines WHERE regexp_matches(line, '(the|der)')")(_line_query(["the", "der"], "any"))
query("find_lines_first", f"WITH {_LINES} SELECT id, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM lines WHERE regexp_matches(line, '(the|der)') GROUP BY id")(_line_query(["the", "der"], "first"))
query("find_lines_all", f"WITH {_LINES} SELECT id, line_no, line FROM lines WHERE regexp_matches(line, '(the).*(and)')")(_line_query(["the", "and"], "all"))
query("find_lines_grep", f"WITH {_LINES} SELECT id, line_no, line FROM lines WHERE regexp_matches(line, '(the|der)') AND regexp_matches(line, '[0-9]+')")(_line_query(["the", "der"], "any", "[0-9]+"))


@query("find_summary", f"WITH t AS (SELECT doc_id AS id, [{normal_sql('x')} for x in {tokens_sql('text')}] AS n FROM documents), p AS (SELECT id, CASE WHEN list_position(n, 'the') > 0 THEN array_to_string(list_slice(n, list_position(n, 'the'), list_position(n, 'the') + 7), ' ') END AS a, CASE WHEN list_position(n, 'der') > 0 THEN array_to_string(list_slice(n, list_position(n, 'der'), list_position(n, 'der') + 7), ' ') END AS b FROM t) SELECT id, concat_ws(' ... ', a, b) AS summary FROM p")
def find_summary(spark, d):
    docs = saved(spark, d).docs
    return docs.select("id", find.summary(F.col("nwords"), ["the", "der"], 8).alias("summary"))


@query("find_counts", f"WITH {TERM}, r AS (SELECT id FROM {_the}) SELECT count(*) FILTER (WHERE regexp_matches({URI}, '^en/')) AS shown, count(*) AS scanned, (SELECT count(*) FROM documents) AS total FROM r JOIN documents ON doc_id = r.id")
def find_counts(spark, d):
    docs = docs_of(spark, d).select(F.col("doc_id").alias("id"), F.expr(URI).alias("uri"))
    return find.counts(boolean.compile(boolean.parse("the").tree, saved_posts(spark, d)), docs, "^en/")


# --- catalog ---


@query("catalog_open", f"SELECT doc_id AS id, {URI} AS uri, len({tokens_sql('text')}) AS words FROM documents")
def catalog_open(spark, d):
    """A catalog saved from an index, and opened."""
    path = storage.scratch(spark, "catalog")
    catalog.save(index_of(spark, d), path)
    return catalog.load(spark, path).docs.select("id", "uri", F.size("nwords").cast("long").alias("words"))


@query("doc_scan", f"SELECT doc_id AS id, {URI} AS uri, lang FROM documents")
def doc_scan(spark, d):
    return saved(spark, d).docs.select("id", "uri", F.col("attrs")["lang"].alias("lang"))


_SOME = "'en/1', 'fr/3', 'de/20', 'xx/0'"


@query("doc_get_by_uri", f"SELECT doc_id AS id, {URI} AS uri, source FROM documents WHERE {URI} IN ({_SOME})")
def doc_get_by_uri(spark, d):
    docs = saved(spark, d).docs
    return docs.where(f"uri in ({_SOME})").select("id", "uri", F.col("attrs")["source"].alias("source"))


@query("doc_get_by_id", f"SELECT doc_id AS id, array_to_string([CASE WHEN {normal_sql('x')} = substr(x, 1, 49) THEN {normal_sql('x')} ELSE substr(x, 1, 49) END for x in {tokens_sql('text')}], ' ') AS awords FROM documents WHERE doc_id = 7")
def doc_get_by_id(spark, d):
    docs = saved(spark, d).docs.where("id = 7")
    stored = F.zip_with("nwords", "awords", lambda n, a: F.when(n != a, a))  # as-is forms that equal the normal ones are not stored
    return docs.select("id", F.array_join(F.zip_with("nwords", stored, lambda n, a: F.coalesce(a, n)), " ").alias("awords"))


@query("doc_id_by_uri", f"SELECT u.uri, coalesce(d.doc_id, -1) AS id FROM (VALUES ('en/1'), ('fr/3'), ('xx/0')) u(uri) LEFT JOIN (SELECT doc_id, {URI} AS uri FROM documents) d USING (uri)")
def doc_id_by_uri(spark, d):
    asked = spark.createDataFrame([("en/1",), ("fr/3",), ("xx/0",)], "uri string")
    docs = docs_of(spark, d).select(F.col("doc_id").alias("id"), F.expr(URI).alias("uri"))
    return asked.join(docs, "uri", "left").select("uri", F.coalesce("id", F.lit(-1)).alias("id"))


@query("doc_check", "SELECT l.doc_id AS id, d.doc_id IS NOT NULL AS found FROM labels l LEFT JOIN documents d USING (doc_id)")
def doc_check(spark, d):
    docs = docs_of(spark, d).select("doc_id", F.lit(True).alias("_f"))
    return table(spark, d, "labels").join(docs, "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("_f", F.lit(False)).alias("found"))


@query("doc_attr", "SELECT doc_id AS id, lang, CAST(n_chars AS VARCHAR) AS size, 'x' || source AS source FROM documents")
def doc_attr(spark, d):
    docs = saved(spark, d).docs.join(docs_of(spark, d).select(F.col("doc_id").alias("id"), "n_chars"), "id")
    put = F.map_concat(F.map_filter("attrs", lambda k, v: ~k.isin("size", "source")), F.create_map(F.lit("size"), F.col("n_chars").cast("string"), F.lit("source"), F.concat(F.lit("x"), F.col("attrs")["source"])))
    return docs.select("id", put.alias("a")).select("id", *[F.col("a")[k].alias(k) for k in ("lang", "size", "source")])


@query("doc_words", f"WITH t AS (SELECT doc_id AS id, {tokens_sql('text')} AS w FROM documents) SELECT id, array_to_string([{normal_sql('x')} for x in w[1:20]], ' ') AS nwords, array_to_string([substr(x, 1, 49) for x in w[1:20]], ' ') AS awords FROM t")
def doc_words(spark, d):
    return index_of(spark, d, 20).docs.select("id", F.array_join("nwords", " ").alias("nwords"), F.array_join("awords", " ").alias("awords"))


_GONE = "doc_id % 19 = 0"  # the deleted documents of the fixtures


@query("doc_delete", f"WITH {POSTINGS} SELECT (SELECT count(*) FROM documents WHERE NOT ({_GONE})) AS docs, count(*) AS postings FROM postings")
def doc_delete(spark, d):
    gone = docs_of(spark, d).where(_GONE).select(F.expr(URI).alias("uri"))
    left = ix.delete(saved(spark, d), gone)
    return left.docs.agg(F.count("*").alias("docs")).join(F.broadcast(left.postings.agg(F.count("*").alias("postings"))))


@query("index_purge", f"WITH {POSTINGS} SELECT word, id, score FROM postings WHERE NOT (id % 19 = 0)")
def index_purge(spark, d):
    gone = docs_of(spark, d).where(_GONE).select(F.expr(URI).alias("uri"))
    return ix.purge(ix.delete(saved(spark, d), gone)).postings


@query("index_optimize", f"WITH {POSTINGS} SELECT word, count(*) AS df, max(score) AS best FROM postings WHERE NOT (id % 19 = 0) GROUP BY word")
def index_optimize(spark, d):
    gone = docs_of(spark, d).where(_GONE).select(F.expr(URI).alias("uri"))
    return ix.optimize(ix.delete(saved(spark, d), gone)).postings.groupBy("word").agg(F.count("*").alias("df"), F.max("score").alias("best"))


def _catalogs(spark, d) -> list[ix.Index]:
    return [saved(spark, d, w) for w in ("doc_id % 3 = 0", "doc_id % 3 = 1 or doc_id % 10 = 0", "doc_id % 3 = 2")]


_MERGED = f"""{POSTINGS},
cat AS (SELECT 0 AS k, doc_id, {URI} AS uri FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 1, doc_id, {URI} FROM documents WHERE doc_id % 3 = 1 OR doc_id % 10 = 0 UNION ALL SELECT 2, doc_id, {URI} FROM documents WHERE doc_id % 3 = 2),
tops AS (SELECT k, max(doc_id) AS top FROM cat GROUP BY k),
bases AS (SELECT k, coalesce(sum(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tops),
mdocs AS (SELECT k, CAST(doc_id + base AS BIGINT) AS id, uri FROM cat JOIN bases USING (k) QUALIFY row_number() OVER (PARTITION BY uri ORDER BY k) = 1),
mposts AS (SELECT k, word, CAST(p.id + base AS BIGINT) AS id, score FROM cat JOIN bases USING (k) JOIN postings p ON p.id = doc_id)"""


@query("catalog_merge", f"WITH {_MERGED} SELECT word, id, score FROM mposts")
def catalog_merge(spark, d):
    return ix.merge(_catalogs(spark, d)).postings


@query("catalog_merge_purged", f"WITH {_MERGED} SELECT word, mposts.id, score, uri FROM mposts JOIN mdocs USING (k, id)")
def catalog_merge_purged(spark, d):
    m = ix.merge(_catalogs(spark, d), purged=True)
    return m.postings.join(m.docs.select("id", "uri"), "id").select("word", "id", "score", "uri")


@query("index_put_upsert", f"""WITH base AS (SELECT doc_id, {URI} AS uri FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT {URI} AS uri FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0),
kept AS (SELECT doc_id AS id, uri FROM base WHERE uri NOT IN (SELECT uri FROM new)), n AS (SELECT uri FROM new)
SELECT uri, max(old) AS old_id, bool_or(fresh) AS fresh FROM (SELECT uri, id AS old, FALSE AS fresh FROM kept UNION ALL SELECT uri, NULL, TRUE FROM n) GROUP BY uri""")
def index_put_upsert(spark, d):
    """uris with the ids that stay; new ids are the engine's own, all beyond the largest, and unique."""
    docs = docs_of(spark, d)
    base = ix.build(docs.where("doc_id % 5 <> 0"), "doc_id", F.expr(URI), "text")
    new = ix.documents(docs.where("doc_id % 5 = 0 or doc_id % 7 = 0"), "doc_id", F.expr(URI), "text").drop("id")
    top = base.docs.agg(F.max("id").alias("top"))
    out = ix.put(base, new).docs.join(F.broadcast(top))
    return out.select("uri", F.when(F.col("id") <= F.col("top"), F.col("id")).alias("old_id"), (F.col("id") > F.col("top")).alias("fresh"))


@query("index_cull", f"SELECT doc_id AS id FROM documents WHERE {URI} NOT IN (SELECT {URI} FROM documents WHERE doc_id % 19 = 0)")
def index_cull(spark, d):
    tree = docs_of(spark, d).where(f"not ({_GONE})").select(F.expr(URI).alias("uri"))
    known = docs_of(spark, d).select(F.col("doc_id").alias("id"), F.expr(URI).alias("uri"))
    return known.join(known.join(tree, "uri", "left_anti"), "uri", "left_anti").select("id")


@query("index_incremental", f"SELECT {URI} AS uri FROM documents WHERE doc_id % 5 = 0 OR doc_id % 17 = 0")
def index_incremental(spark, d):
    """What is to be indexed again: unknown uris, and those whose date differs."""
    now = docs_of(spark, d).select(F.expr(URI).alias("uri"), (F.col("doc_id") * 60 + F.when(F.expr("doc_id % 5 = 0"), 1).otherwise(0)).alias("mtime"))
    known = docs_of(spark, d).where("doc_id % 17 <> 0").select(F.expr(URI).alias("uri"), (F.col("doc_id") * 60).alias("date"))
    return now.join(known, "uri", "left").where("date is null or date <> mtime").select("uri")


def _keywords_sql(idf: bool, most: int) -> str:
    again = f"SELECT k.id, k.word, CAST(trunc(num / greatest(8.0::DOUBLE, pow({log_sql('df')}, 3) / 8.0)) AS BIGINT) AS num FROM pool k JOIN dfs USING (word)" if idf else "SELECT id, word, num FROM pool"
    order = "PARTITION BY id ORDER BY num DESC, strlen(word) DESC, word"
    return f"""{POSTINGS}, dfs AS (SELECT word, count(*) AS df FROM postings GROUP BY word),
raw AS (SELECT id, word, tf * 10000 AS num FROM tf), pool AS (SELECT * FROM raw QUALIFY row_number() OVER ({order}) <= {int(1.75 * most)}), w AS ({again}),
kw AS (SELECT id, CAST(row_number() OVER ({order}) AS INT) AS rank, word, num FROM w QUALIFY row_number() OVER ({order}) <= {most})"""


@query("doc_keywords", f"WITH {_keywords_sql(True, 8)} SELECT id, rank, word, num FROM kw")
def doc_keywords(spark, d):
    i = saved(spark, d)
    return ix.keywords(i.docs, 8, ix.document_frequency(i.postings))


@query("doc_keywords_noidf", f"WITH {_keywords_sql(False, 8)} SELECT id, rank, word, num FROM kw")
def doc_keywords_noidf(spark, d):
    return ix.keywords(saved(spark, d).docs, 8)


@query("doc_similarity", f"WITH {_keywords_sql(True, 8)}, norms AS (SELECT id, sqrt(sum(num * num)) AS x FROM kw GROUP BY id), dots AS (SELECT p.id AS a, q.id AS b, CAST(sum(p.num * q.num) AS BIGINT) AS dot FROM kw p JOIN kw q ON p.word = q.word AND p.id < q.id GROUP BY p.id, q.id) SELECT a, b, dot, round(dot / (m.x * n.x), 6) AS cosine FROM dots JOIN norms m ON m.id = a JOIN norms n ON n.id = b WHERE dot / (m.x * n.x) >= 0.5 - 1e-9")
def doc_similarity(spark, d):
    i = saved(spark, d)
    return ix.similarity(ix.keywords(i.docs, 8, ix.document_frequency(i.postings))).withColumn("cosine", F.round("cosine", 6))


_V = "embedding::DOUBLE[]"


@query("vec_dot", f"SELECT a.vec_id, round(list_inner_product(a.{_V}, b.{_V}), 6) AS dot FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def vec_dot(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("dot"))


@query("vec_norm", f"SELECT vec_id, round(sqrt(list_inner_product({_V}, {_V})), 6) AS norm FROM embeddings")
def vec_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("vec_cosine", f"SELECT a.vec_id, round(greatest(0.0, list_cosine_similarity(a.{_V}, b.{_V})), 6) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def vec_cosine(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


