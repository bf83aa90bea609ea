"""String, URL, markup and date scalars over pages, parts, documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.functions import dates, markup, strings
from lexistrata.queries.common import Query, quoted, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_FOLD = f"translate(text, {_UP}, {_LOW})"


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def scalar(name: str, sql: str, column, **more) -> None:
    """A query of id and value over documents, and the SQL expression for value."""
    query(name, f"SELECT doc_id AS id, {sql} AS value FROM documents")(lambda spark, d: docs(spark, d).select("id", column(F.col("text")).alias("value")))


_TRIM = "chr(7) || chr(8) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_PADDED = f"({_TRIM} || text || chr(11) || ' ' || chr(7))"


def padded(t):
    return F.concat(F.lit("\x07\x08\t\n\x0b\x0c\r "), t, F.lit("\x0b \x07"))


def _hexed(t, sign: str):
    """Every byte of a text as the sign and two hex digits, not by this library's encoders."""
    return F.regexp_replace(F.hex(F.encode(t, "utf-8")), "(..)", sign + "$1")


scalar("str_icmp", f"CASE WHEN {_FOLD} < 'the' THEN -1 WHEN {_FOLD} > 'the' THEN 1 ELSE 0 END", lambda t: strings.icmp(t, F.lit("The")))
scalar("str_fw", "starts_with(text, 'The')", lambda t: strings.starts_with(t, F.lit("The")))
scalar("str_fwi", f"starts_with({_FOLD}, 'th')", lambda t: strings.starts_with(t, F.lit("TH"), True))
scalar("str_bw", "ends_with(text, 'n.')", lambda t: strings.ends_with(t, F.lit("n.")))
scalar("str_bwi", f"ends_with({_FOLD}, 'e.')", lambda t: strings.ends_with(t, F.lit("E."), True))
scalar("str_upper", f"md5(translate(text, {_LOW}, {_UP}))", lambda t: F.md5(strings.to_upper(t)))
scalar("str_lower", f"md5({_FOLD})", lambda t: F.md5(strings.to_lower(t)))
scalar("str_trim", f"md5(trim({_PADDED}, {_TRIM}))", lambda t: F.md5(strings.trim(padded(t))))
scalar("str_squeeze", f"md5(regexp_replace(regexp_replace({_PADDED}, '([\\x01-\\x20])[\\x01-\\x20]+', '\\1', 'g'), '^[\\x01-\\x20]+|[\\x01-\\x20]+$', '', 'g'))", lambda t: F.md5(strings.squeeze(padded(t))))
scalar("str_split", "CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(text, '[ ,.\\n]')) END", lambda t: F.size(strings.split(t, " ,.\n")).cast("long"))
scalar("str_replace_map", "md5(replace(replace(replace(replace(replace(text, 'the', chr(1)), 'th', chr(2)), 'e', chr(3)), chr(1), 'th'), chr(2), '[e]').replace(chr(3), ''))", lambda t: F.md5(strings.replace_map(t, [("the", "th"), ("th", "[e]"), ("e", "")])))
scalar("str_format", "printf('%s has %d characters, %05.1f%%', doc_id::VARCHAR, length(text), length(text) / 7.0)", lambda t: F.format_string("%s has %d characters, %05.1f%%", F.col("id").cast("string"), F.char_length(t), F.char_length(t) / F.lit(7.0)))
scalar("b64_encode", "base64(encode(text))", strings.base64_encode)
scalar("b64_decode", "md5(text)", lambda t: F.md5(strings.base64_decode(F.to_char(F.encode(t, "utf-8"), F.lit("base64")))))
scalar("qp_encode", "strlen(text) + 2 * (strlen(text) - strlen(regexp_replace(text, '[^\\x09\\x0A\\x0D\\x20-\\x3C\\x3E-\\x7E]', '', 'g')))", lambda t: F.octet_length(strings.quoted_printable_encode(t)).cast("long"))
scalar("qp_decode", "md5(text)", lambda t: F.md5(strings.quoted_printable_decode(F.concat(_hexed(t, "="), F.lit("=\r\n")))))
scalar("mime_word", "'=?UTF-8?B?' || base64(encode(source)) || '?= ' || source", lambda t: F.concat_ws(" ", strings.mime_word_encode(F.col("source")), strings.mime_word_decode(strings.mime_word_encode(F.col("source"), "Q"))))
scalar("csv_escape", "'\"' || replace(text, '\"', '\"\"') || '\"'", markup.csv_escape)
scalar("csv_unescape", "md5(text)", lambda t: F.md5(markup.csv_unescape(F.concat(F.lit('"'), F.array_join(F.split(t, '"', -1), '""'), F.lit('"')))))
scalar("csv_rows", "len([x for x in string_split_regex(text, '[\\r\\n]+') if x <> '']) + 1", lambda t: F.size(markup.csv_rows(F.concat(F.regexp_replace(t, '"', ""), F.lit('\n"a\n""b",c')))).cast("long"))
scalar("csv_cells", "doc_id || '|' || lang || '|x,\"' || source || '|'", lambda t: F.array_join(markup.csv_cells(F.concat(F.col("id").cast("string"), F.lit(","), F.col("lang"), F.lit(',"x,""'), F.col("source"), F.lit('",'))), "|"))
scalar("iconv_latin1", "md5(regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g'))", lambda t: F.md5(strings.transcode(t)))
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(lang || ' ' || source || ' ' || doc_id, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
scalar("crc32", f"xor({_CRC}, 4294967295)", lambda t: strings.crc32(F.concat_ws(" ", "lang", "source", F.col("id").cast("string"))))
for _kind in ("zlib", "raw", "gzip"):
    scalar(f"deflate_{_kind}", "md5(text) || CASE WHEN strlen(text) >= 1000 THEN ' smaller' ELSE '' END", lambda t, k=_kind: _packed(strings.deflate(t, k), t, k))


def _packed(data, t, kind: str):
    return F.concat(F.md5(strings.inflate(data, kind)), F.when((F.octet_length(t) >= 1000) & (F.octet_length(data) < F.octet_length(t)), " smaller").otherwise(""))


# --- pages ---


def pages(spark, d) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", "html")


_EXTRA = [(-1, "http://joe:pw@Example.org:8080/a/b.html?x=1#top"), (-2, "ftp://h"), (-3, "/only/path/.."), (-4, "mailto")]
_EXTRA_SQL = "UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(u)})" for i, u in _EXTRA) + ")"
_URL = quoted(r"^(?:(https?|ftp|file)://)?(?:([^@/?#]*)@)?([^:/?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$")
_PARTS = ("scheme", "authority", "host", "port", "path", "query", "fragment")


@query(
    "url_break",
    f"WITH u AS (SELECT page_id AS id, url FROM pages {_EXTRA_SQL}), p AS (SELECT id, url, " + ", ".join(f"regexp_extract(url, {_URL}, {i + 1}) AS {n}" for i, n in enumerate(_PARTS)) + f"), q AS (SELECT * REPLACE (CASE WHEN path = '' THEN '/' ELSE path END AS path) FROM p), r AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS file FROM q) "
    + " UNION ALL ".join(f"SELECT id, '{n}' AS key, {v} AS value FROM r WHERE {v} <> ''{more}" for n, v, more in [("self", "url", ""), *[(n, n, "") for n in _PARTS], ("file", "file", " AND file NOT IN ('.', '..')")]),
)
def url_break(spark, d):
    rows = pages(spark, d).select("id", "url").unionByName(spark.createDataFrame(_EXTRA, "id long, url string"))
    return rows.select("id", F.explode(markup.url_break(F.col("url"))).alias("key", "value"))


ORACLE_SQL["url_break"] = ORACLE_SQL["url_break"].replace(") AS fragment), q AS", ") AS fragment FROM u), q AS")


@query("url_encode", "SELECT page_id AS id, replace(url_encode(url || ' *~é'), '~', '%7E') AS value FROM pages")
def url_encode(spark, d):
    return pages(spark, d).select("id", markup.url_encode(F.concat("url", F.lit(" *~é"))).alias("value"))


@query("url_decode", "SELECT page_id AS id, url || ' é*' AS value, 'a b' AS plus, 'ab' AS cut FROM pages")
def url_decode(spark, d):
    t = F.concat("url", F.lit(" é*"))
    return pages(spark, d).select("id", markup.url_decode(_hexed(t, "%")).alias("value"), markup.url_decode(F.lit("a+b")).alias("plus"), markup.url_decode(F.lit("ab%G1cd")).alias("cut"))


_XML = quoted(r"(?s)<!--.*?-->|<[^>]*>|[^<]+")


@query("xml_break", f"WITH x AS (SELECT page_id AS id, regexp_extract_all(html, {_XML}) AS l FROM pages) SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS section FROM x")
def xml_break(spark, d):
    return pages(spark, d).select("id", F.posexplode(markup.xml_break(F.col("html"))).alias("pos", "section"))


@query("xml_attrs", f"""WITH x AS (SELECT page_id AS id, unnest(regexp_extract_all(html, {_XML})) AS tag FROM pages), t AS (SELECT DISTINCT tag FROM x WHERE regexp_matches(tag, '^<[a-z]')),
a AS (SELECT tag, unnest(regexp_extract_all(tag, '[a-z_-]+="[^"]*"')) AS a FROM t)
SELECT tag, '' AS key, regexp_extract(tag, '^<([a-z0-9]+)', 1) AS value FROM t UNION ALL SELECT tag, regexp_extract(a, '^([^=]+)=', 1), replace(replace(replace(replace(replace(regexp_extract(a, '="(.*)"$', 1), '&apos;', ''''), '&quot;', '"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&') FROM a""")
def xml_attrs(spark, d):
    tags = pages(spark, d).select(F.explode(markup.xml_break(F.col("html"))).alias("tag")).where(F.col("tag").rlike("^<[a-z]")).distinct()
    return tags.select("tag", F.explode(markup.xml_attributes(F.col("tag"))).alias("e")).select("tag", "e.key", "e.value")


_ESC = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("xml_escape", f"SELECT page_id AS id, {_ESC} AS value FROM pages")
def xml_escape(spark, d):
    return pages(spark, d).select("id", markup.xml_escape(F.col("html")).alias("value"))


@query("xml_unescape", "SELECT page_id AS id, html AS value, '&lt;' AS once FROM pages")
def xml_unescape(spark, d):
    plain = F.col("html")
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        plain = F.array_join(F.split(plain, char, -1), f"&{name};")
    return pages(spark, d).select("id", markup.xml_unescape(plain).alias("value"), markup.xml_unescape(F.lit("&amp;lt;")).alias("once"))


# --- messages ---


def _message():
    return F.concat(F.lit("From: conv"), F.col("conv_id").cast("string"), F.lit("\r\nSubject: turn\r\n  "), F.col("turn").cast("string"), F.lit("\r\nX-Role: "), F.col("role"), F.lit("\r\n\r\n"), F.col("text"))


@query("mime_break", "SELECT conv_id, turn, 'conv' || conv_id AS sender, 'turn ' || turn AS subject, role, md5(text) AS body FROM conversations")
def mime_break(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "turn", markup.mime_break(_message()).alias("m"))
    h = F.col("m.headers")
    return m.select("conv_id", "turn", h["from"].alias("sender"), h["subject"].alias("subject"), h["x-role"].alias("role"), F.md5("m.body").alias("body"))


@query("mime_parts", "SELECT conv_id, turn, unnest([0, 1]) AS pos, unnest([md5(text), md5(role)]) AS part FROM conversations")
def mime_parts(spark, d):
    body = F.concat(F.lit("preamble\n--b1\n"), F.col("text"), F.lit("\n--b1\n"), F.col("role"), F.lit("\n--b1--\nend"))
    m = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(markup.mime_parts(body, F.lit("b1"))).alias("pos", "p"))
    return m.select("conv_id", "turn", "pos", F.md5("p").alias("part"))


# --- dates ---


def seconds(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), dates.epoch_seconds(F.col("ts")).alias("t"))


_T = "SELECT event_id AS id, date_trunc('second', ts) AS t, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events"


@query("date_calendar", f"WITH e AS ({_T}), l AS (SELECT id, t + INTERVAL 9 HOUR AS t FROM e) SELECT id, CAST(year(t) AS INT) AS year, CAST(month(t) AS INT) AS month, CAST(day(t) AS INT) AS day, CAST(hour(t) AS INT) AS hour, CAST(minute(t) AS INT) AS minute, CAST(second(t) AS INT) AS second FROM l")
def date_calendar(spark, d):
    return seconds(spark, d).select("id", dates.calendar(F.col("t"), 9 * 3600).alias("c")).select("id", "c.*")


@query("date_dow", f"WITH e AS ({_T}) SELECT id, CAST(dayofweek(t) AS INT) AS dow FROM e")
def date_dow(spark, d):
    return seconds(spark, d).select("id", dates.day_of_week(F.col("t")).alias("dow"))


@query("date_w3c", f"WITH e AS ({_T}) SELECT id, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(t + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S+09:00') AS jst FROM e")
def date_w3c(spark, d):
    return seconds(spark, d).select("id", dates.w3c(F.col("t")).alias("utc"), dates.w3c(F.col("t"), 9 * 3600).alias("jst"))


@query("date_http", f"WITH e AS ({_T}) SELECT id, strftime(t, '%a, %d %b %Y %H:%M:%S GMT') AS value FROM e")
def date_http(spark, d):
    return seconds(spark, d).select("id", dates.rfc1123(F.col("t")).alias("value"))


@query("date_parse", f"WITH e AS ({_T}) SELECT id, s AS http, s AS w3c, s AS jst, s AS number, CAST(0 AS BIGINT) + s - s % 86400 AS slashes, s + 4 * 3600 AS edt, CAST(255 AS BIGINT) AS hex, CAST(-1 AS BIGINT) AS bad FROM e")
def date_parse(spark, d):
    t = F.col("t")
    day = F.substring(dates.w3c(t), 1, 10)
    return seconds(spark, d).select(
        "id", dates.parse(dates.rfc1123(t)).alias("http"), dates.parse(dates.w3c(t)).alias("w3c"), dates.parse(dates.w3c(t, 9 * 3600)).alias("jst"), dates.parse(t.cast("string")).alias("number"),
        dates.parse(F.replace(day, F.lit("-"), F.lit("/"))).alias("slashes"), dates.parse(F.replace(F.regexp_replace(dates.rfc1123(t), "^[A-Za-z]+, ", ""), F.lit("GMT"), F.lit("EDT"))).alias("edt"), dates.parse(F.lit("0xFF")).alias("hex"), dates.parse(F.lit("soon")).alias("bad"),
    )


@query("date_jetlag", f"WITH e AS ({_T}) SELECT id, CAST(32400 AS BIGINT) AS tokyo, CAST(epoch(t) - epoch(timezone('Europe/Berlin', timezone('UTC', t))::TIMESTAMP) AS BIGINT) * -1 AS berlin FROM e")
def date_jetlag(spark, d):
    return seconds(spark, d).select("id", dates.jetlag(F.col("t"), "Asia/Tokyo").alias("tokyo"), dates.jetlag(F.col("t"), "Europe/Berlin").alias("berlin"))
