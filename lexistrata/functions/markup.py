"""URLs, XML, CSV and mail messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(?:(https?|ftp|file)://)?(?:([^@/?#]*)@)?([^:/?#]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_break(url: Column) -> Column:
    """Map of self and, where present: scheme (http, https, ftp, file), authority (user information), host, port, path (`/` if
    there is none), file (the path's last segment, unless `.` or `..`), query, fragment."""
    part = {name: F.regexp_extract(url, _URL, i + 1) for i, name in enumerate(("scheme", "authority", "host", "port", "path", "query", "fragment"))}
    part["path"] = F.when(part["path"] == "", "/").otherwise(part["path"])
    file = F.regexp_extract(part["path"], "([^/]*)$", 1)
    part["file"] = F.when(file.isin(".", ".."), "").otherwise(file)
    entries = F.array(F.struct(F.lit("self").alias("k"), url.alias("v")), *[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in part.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"] != ""))


def url_encode(s: Column) -> Column:
    """Letters, digits, `_`, `-` and `.` stay; all other bytes become %XX."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(s), "\\+", "%20"), "\\*", "%2A")


def url_decode(s: Column) -> Column:
    """`+` is a blank; the text ends before a malformed %."""
    bad = F.regexp_instr(s, F.lit("%(?![0-9A-Fa-f]{2})"))
    return F.url_decode(F.when(bad > 0, F.substr(s, F.lit(1), bad - 1)).otherwise(s))


def xml_break(s: Column, comments: bool = True) -> Column:
    """Tags, comments and text sections, in order; CDATA sections as escaped text."""
    cuts = F.regexp_extract_all(s, F.lit(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[^>]*>|[^<]+"), F.lit(0))
    cuts = cuts if comments else F.filter(cuts, lambda c: ~F.startswith(c, F.lit("<!--")))
    return F.transform(cuts, lambda c: F.when(F.startswith(c, F.lit("<![CDATA[")), xml_escape(F.regexp_extract(c, r"(?s)^<!\[CDATA\[(.*?)\]\]>$", 1))).otherwise(c))


def xml_attributes(tag: Column) -> Column:
    """Entries (key, value): "" with the tag's name, then attributes with unescaped values; quotes are optional, the first of a
    repeated name counts."""
    name = F.regexp_extract(tag, r"^<\s*(/?[^\s/>]+)", 1)
    body = F.regexp_extract(tag, r"(?s)^<\s*/?[^\s/>]+(.*?)/?>$", 1)
    found = F.regexp_extract_all(body, F.lit(r"""(?s)[^\s=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"']+)"""), F.lit(0))
    pairs = F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"^([^\s=]+)", 1).alias("key"), xml_unescape(F.regexp_extract(a, r"""(?s)=\s*["']?(.*?)["']?$""", 1)).alias("value")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["key"] == p["key"]))
    return F.concat(F.array(F.struct(F.lit("").alias("key"), name.alias("value"))), first)


#: The five entities.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]


def xml_escape(s: Column) -> Column:
    for char, entity in ENTITIES:
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def xml_unescape(s: Column) -> Column:
    for char, entity in reversed(ENTITIES):  # the ampersand last
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def csv_rows(s: Column) -> Column:
    """Rows of a CSV text; line ends inside quotes belong to their row."""
    return F.filter(F.regexp_extract_all(s, F.lit(r'(?:"[^"]*+(?:""[^"]*+)*+"|[^"\r\n]++)++'), F.lit(0)), lambda r: r != "")


def csv_cells(row: Column) -> Column:
    """Cells of a row, without outer quotes and with doubled ones single."""
    raw = F.regexp_extract_all(F.concat(row, F.lit(",")), F.lit(r'((?:"[^"]*+(?:""[^"]*+)*+"|[^",]++)*+),'), F.lit(1))
    return F.transform(raw, csv_unescape)


def csv_escape(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_unescape(s: Column) -> Column:
    inner = F.when(F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"')) & (F.char_length(s) >= 2), F.substr(s, F.lit(2), F.char_length(s) - 2)).otherwise(s)
    return F.replace(inner, F.lit('""'), F.lit('"'))


def mime_break(message: Column) -> Column:
    """struct(headers map with lower-case names, body): the header ends at the first blank line; continuation lines unfold."""
    cut = F.regexp_replace(message, "\\r\\n", "\n")
    at = F.instr(cut, "\n\n")
    head = F.regexp_replace(F.when(at > 0, F.substr(cut, F.lit(1), at - 1)).otherwise(cut), "\\n[ \\t]+", " ")
    lines = F.filter(F.split(head, "\n"), lambda h: F.contains(h, F.lit(":")))
    pairs = F.transform(lines, lambda h: F.struct(F.lower(F.trim(F.regexp_extract(h, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(h, "(?s)^[^:]*:(.*)$", 1)).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return F.struct(F.map_from_entries(first).alias("headers"), F.when(at > 0, F.substr(cut, at + 2)).otherwise("").alias("body"))


def mime_parts(body: Column, boundary: Column) -> Column:
    """Parts between boundary lines; what is before the first and after the last goes."""
    chunks = F.split(F.concat(F.lit("\n"), body), F.concat(F.lit("\\n--\\Q"), boundary, F.lit("\\E(?:--)?\\n?")))
    return F.slice(chunks, 2, F.greatest(F.size(chunks) - 2, F.lit(0)))
