"""The boolean query language: words joined by & (and), | (or), ! (and not), parentheses; operators have equal precedence and
group to the left.

Two adjacent words get an & between them; next to a parenthesis none is added, and what follows there is left out of the query.
parse() gives the tree with collected errors; compile() turns it into one scan and one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistrata.functions.text import STANDARD, CharClasses, score_log

# The messages that the query language reports.
NOT_CLOSED = "Expression ended without closing ')'"
UNBALANCED = "Un-balanced parenthesis."
INVALID = "Invalid sub-expression. Expected '(' or WORD."


class QueryFailed(ValueError):
    """A query without a value: it is empty, or ends where an operand is due."""


@dataclass(frozen=True)
class Word:
    word: str


@dataclass(frozen=True)
class Nothing:
    """An operand that matches no document."""


@dataclass(frozen=True)
class Op:
    kind: str
    left: object
    right: object


@dataclass
class Query:
    tree: object
    errors: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)


def lex(text: str, classes: CharClasses = STANDARD) -> list[tuple[str, str]]:
    """(token, word): word is empty for what is no word of the language. Operators and parentheses that begin a run of
    delimiters become tokens of their own, one by one; & goes between two words with neither of these between them."""
    out: list[tuple[str, str]] = []
    after_word = False
    for token, word in zip(*classes.tokenize(text), strict=True):
        rest = token
        if token[0] in classes.delimiter:
            while rest and rest[0] in "&|!()":
                out.append((rest[0], ""))
                rest, after_word = rest[1:], False
            if rest:
                out.append((rest, ""))
            continue
        if not word or word[0] in classes.glue:
            word = ""
        if word and after_word:
            out.append(("&", ""))
        after_word = after_word or bool(word)
        out.append((token, word))
    return out


def parse(text: str, classes: CharClasses = STANDARD) -> Query:
    tokens = lex(text, classes)
    query = Query(None, tokens=[t for t, _ in tokens])
    at = 0

    def operand():
        nonlocal at
        if at >= len(tokens):
            return None
        token, word = tokens[at]
        at += 1
        if word:
            return Word(word)
        if token == "(":
            inner = expression()
            if at >= len(tokens):
                query.errors.append(NOT_CLOSED)
            else:
                if tokens[at][0] != ")":
                    query.errors.append(UNBALANCED)
                at += 1
            return inner
        query.errors.append(INVALID)
        return Nothing()

    def expression():
        nonlocal at
        left = operand()
        while left is not None and at < len(tokens) and tokens[at][0] in ("&", "|", "!"):
            kind = tokens[at][0]
            at += 1
            right = operand()
            left = None if right is None else Op(kind, left, right)
        return left

    query.tree = expression()
    if query.tree is None:
        raise QueryFailed("; ".join(["the query has no value", *query.errors]))
    query.ignored = [t for t, _ in tokens[at:]]
    return query


def words(tree) -> list[str]:
    if isinstance(tree, Word):
        return [tree.word]
    if isinstance(tree, Op):
        return list(dict.fromkeys(words(tree.left) + words(tree.right)))
    return []


def _value(tree, column: dict[str, Column]) -> Column:
    """A document's score under the tree; null where it does not match."""
    if isinstance(tree, Word):
        return column[tree.word]
    if isinstance(tree, Nothing):
        return F.lit(None).cast("long")
    a, b = _value(tree.left, column), _value(tree.right, column)
    if tree.kind == "&":
        return a + b
    if tree.kind == "|":
        return F.coalesce(a + b, a, b)
    return F.when(b.isNull(), a)


def weighed(posts: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the terms with scores divided by the document frequency's term of 4 at least, cut to whole.

    Frequencies are one row for each term of the query, which bounds what is broadcast."""
    some = posts.where(F.col("word").isin(terms)) if terms else posts.where(F.lit(False))
    df = some.groupBy("word").agg(F.count("*").alias("df"))
    d = F.greatest(F.lit(4.0), F.pow(score_log(F.col("df")), 2.0) / 4.0)
    return some.join(F.broadcast(df), "word").select("word", "id", (F.col("score") / d).cast("long").alias("score"))


def compile(tree, posts: DataFrame) -> DataFrame:
    """id, score of the matching documents. All terms come from one filtered scan; a document's terms meet in one aggregation
    whatever the shape of the query, and the tree is a column expression over them. No joins of id sets, no common word's
    postings in one task."""
    terms = words(tree)
    by_doc = weighed(posts, terms).groupBy("id").agg(*[F.max(F.when(F.col("word") == t, F.col("score"))).alias(f"t{i}") for i, t in enumerate(terms)] or [F.lit(None).cast("long").alias("t0")])
    value = _value(tree, {t: F.col(f"t{i}") for i, t in enumerate(terms)})
    return by_doc.select("id", value.alias("score")).where("score is not null")


def run(text: str, posts: DataFrame, classes: CharClasses = STANDARD) -> tuple[DataFrame, list[str]]:
    """The matching documents, best first, and what the parser reported."""
    q = parse(text, classes)
    more = [f"Ignored: {' '.join(q.ignored)}"] if q.ignored else []
    return compile(q.tree, posts).orderBy(F.desc("score"), "id"), q.errors + more


def page(results: DataFrame, first: int, count: int) -> DataFrame:
    """Rows first .. first + count - 1 (from 0) of the ranked results, with their rank. Only first + count rows are ranked."""
    from pyspark.sql import Window

    top = results.orderBy(F.desc("score"), "id").limit(first + count)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)
    return ranked.where(F.col("rank") >= first).select("rank", "id", "score")
