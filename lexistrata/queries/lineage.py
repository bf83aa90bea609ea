"""Revision graph and meta-data queries; conversations serve as revisions: a turn's parent is the turn before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.operators import lineage as ln
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


_REV = """revisions AS (SELECT md5(concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING))) AS id,
CASE WHEN turn = 0 THEN 'NONE' ELSE md5(concat(CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING))) END AS parent_id, role AS revision, concat('user', CAST(conv_id % 5 AS STRING)) AS email, conv_id, turn, text FROM conversations)"""


def revisions(spark, d) -> DataFrame:
    return spark.sql(f"WITH {_REV.replace('FROM conversations', 'FROM {conversations}')} SELECT * FROM revisions", conversations=table(spark, d, "conversations"))


@query("changeset_list", f"WITH {_REV} SELECT id FROM revisions WHERE regexp_matches(id, '^[a-zA-Z0-9]')")
def changeset_list(spark, d):
    return revisions(spark, d).where(F.col("id").rlike("^[a-zA-Z0-9]")).select("id")


@query("changeset_delete", f"WITH {_REV} SELECT id FROM revisions WHERE revision <> 'assistant'")
def changeset_delete(spark, d):
    r = revisions(spark, d)
    return r.join(r.where("revision = 'assistant'").select("id"), "id", "left_anti").select("id")


@query("revision_tree", f"WITH {_REV}, k AS (SELECT parent_id AS id, string_agg(id, ',' ORDER BY id) AS children FROM revisions GROUP BY parent_id), i AS (SELECT id FROM revisions UNION ALL SELECT 'NONE') SELECT i.id, coalesce(children, '') AS children FROM i LEFT JOIN k ON k.id = i.id")
def revision_tree(spark, d):
    return ln.tree(revisions(spark, d)).select("id", F.array_join("children", ",").alias("children"))


@query("children_of", f"WITH {_REV} SELECT parent_id, id FROM revisions WHERE parent_id IN (SELECT id FROM revisions WHERE turn = 0)")
def children_of(spark, d):
    r = revisions(spark, d)
    return ln.children(r, r.where("turn = 0"))


@query("parent_of", f"WITH {_REV} SELECT id, parent_id FROM revisions")
def parent_of(spark, d):
    return ln.parent(revisions(spark, d))


_PATH = f"WITH RECURSIVE {_REV}, p AS (SELECT id, id AS path, id AS root, 0 AS depth FROM revisions WHERE parent_id = 'NONE' UNION ALL SELECT r.id, p.path || '/' || r.id, p.root, p.depth + 1 FROM revisions r JOIN p ON r.parent_id = p.id)"


@query("revision_path", f"{_PATH} SELECT id, path FROM p")
def revision_path(spark, d):
    return ln.paths(revisions(spark, d), 100_000)


@query("revision_depth", f"{_PATH} SELECT id, root, depth FROM p")
def revision_depth(spark, d):
    return ln.depths(revisions(spark, d))


@query("revision_list", f"WITH {_REV} SELECT id, revision FROM revisions WHERE parent_id = md5('0-0')")
def revision_list(spark, d):
    """Children of the path's top, which is the first revision."""
    r = revisions(spark, d)
    return r.where(F.col("parent_id") == F.md5(F.lit("0-0"))).select("id", "revision")


@query("readable_name", f"WITH {_REV}, c AS (SELECT *, revision || '-' || substr(id, 1, 3) AS n2, count(*) OVER (PARTITION BY parent_id, revision) AS c1, count(*) OVER (PARTITION BY parent_id, revision || '-' || substr(id, 1, 3)) AS c2 FROM revisions) SELECT id, CASE WHEN c1 = 1 THEN revision WHEN c2 = 1 THEN n2 ELSE email || '-' || n2 END AS name FROM c")
def readable_name(spark, d):
    return ln.readable_names(revisions(spark, d))


@query("revision_find", f"WITH {_REV} SELECT id, revision FROM revisions WHERE revision = 'user'")
def revision_find(spark, d):
    return revisions(spark, d).where("revision = 'user'").select("id", "revision")


_NAMES = "'user', 'assistant', 'nobody', 'c7'"


@query("revision_resolve", f"WITH {_REV}, r AS (SELECT id, CASE WHEN turn = 0 AND conv_id = 7 THEN 'c7' ELSE revision END AS revision FROM revisions), c AS (SELECT revision, count(*) AS n, min(id) AS id FROM r GROUP BY revision) SELECT x.revision, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN id END AS id FROM unnest([{_NAMES}]) x(revision) LEFT JOIN c USING (revision)")
def revision_resolve(spark, d):
    r = revisions(spark, d).withColumn("revision", F.when(F.expr("turn = 0 and conv_id = 7"), "c7").otherwise(F.col("revision")))
    return ln.resolve(r, spark.createDataFrame([(n.strip(" '"),) for n in _NAMES.split(",")], "revision string"))


@query("apply_guard", f"WITH {_REV} SELECT id FROM revisions WHERE parent_id = md5('3-0')")
def apply_guard(spark, d):
    return ln.guarded(revisions(spark, d), F.md5(F.lit("3-0"))).select("id")


_LETTER = "chr(97 + (conv_id % 26)::INT)"


@query("revision_succ", f"""SELECT conv_id, turn, '1.' || lpad(CAST(turn + 1 AS VARCHAR), CAST(greatest(3, length(CAST(turn + 1 AS VARCHAR))) AS INT), '0') AS next,
'a.' || CASE WHEN {_LETTER} = 'z' THEN 'aa' ELSE chr(98 + (conv_id % 26)::INT) END AS letter,
CASE WHEN {_LETTER} = 'z' THEN 'b-a' ELSE 'a-' || chr(98 + (conv_id % 26)::INT) END AS carried, 'rc' || CAST(turn + 1 AS VARCHAR) AS mixed FROM conversations""")
def revision_succ(spark, d):
    t = table(spark, d, "conversations")
    turn, digits = F.col("turn").cast("string"), F.greatest(F.lit(3), F.length(F.col("turn").cast("string")))
    letter = F.char(F.lit(97) + F.col("conv_id") % 26)
    names = {"next": F.concat(F.lit("1."), F.lpad(turn, digits, F.lit("0"))), "letter": F.concat(F.lit("a."), letter), "carried": F.concat(F.lit("a-"), letter), "mixed": F.concat(F.lit("rc"), turn)}
    return t.select("conv_id", "turn", *[ln.successor(c).alias(n) for n, c in names.items()])


@query("md_log", "SELECT conv_id, string_agg(CAST(turn AS STRING) || ':' || CAST(length(text) AS STRING), ' ' ORDER BY turn DESC) AS journal FROM conversations GROUP BY conv_id")
def md_log(spark, d):
    """Each changeset's log, newest entry first."""
    entries = F.reverse(F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").alias("n")))))
    log = table(spark, d, "conversations").groupBy("conv_id").agg(entries.alias("j"))
    return log.select("conv_id", F.array_join(F.transform("j", lambda e: F.concat(e["turn"].cast("string"), F.lit(":"), e["n"].cast("string"))), " ").alias("journal"))


@query("md_disposition", f"WITH {_REV} SELECT id, 'revision:' || parent_id || ':merge' AS disposition FROM revisions WHERE parent_id <> 'NONE'")
def md_disposition(spark, d):
    """A disposition entry is appended to the meta-data's list, which begins empty."""
    empty = F.array().cast("array<struct<type:string,id:string,relation:string>>")
    entry = F.struct(F.lit("revision").alias("type"), F.col("parent_id").alias("id"), F.lit("merge").alias("relation"))
    r = revisions(spark, d).where(F.col("parent_id") != ln.ROOT).withColumn("disposition", F.concat(empty, F.array(entry)))
    return r.select("id", F.explode("disposition").alias("e")).select("id", F.concat_ws(":", "e.type", "e.id", "e.relation").alias("disposition"))


@query("md_files", f"WITH {_REV} SELECT id, 'journal-' || id AS journal, md5(text) AS digest FROM revisions")
def md_files(spark, d):
    """The journal file of each changeset's contents, by purpose."""
    contents = F.array(F.struct(F.concat(F.lit("data-"), "id").alias("name"), F.md5("id").alias("digest"), F.lit("data").alias("purpose")), F.struct(F.concat(F.lit("journal-"), "id").alias("name"), F.md5("text").alias("digest"), F.lit("journal").alias("purpose")))
    first = F.filter(contents, lambda c: c["purpose"] == "journal")[0]
    return revisions(spark, d).select("id", first["name"].alias("journal"), first["digest"].alias("digest"))


@query("env_filter", "SELECT 'event.' || event_type || '.' || CAST(user_id % 10 AS STRING) AS key, CAST(count(*) AS STRING) AS value FROM events GROUP BY 1 HAVING regexp_matches('event.' || event_type || '.' || CAST(user_id % 10 AS STRING), 'click|[.]7$') OR regexp_matches(CAST(count(*) AS STRING), '99')".replace("GROUP BY 1 HAVING", "GROUP BY event_type, user_id % 10 HAVING"))
def env_filter(spark, d):
    env = table(spark, d, "events").groupBy(F.concat_ws(".", F.lit("event"), "event_type", (F.col("user_id") % 10).cast("string")).alias("key")).agg(F.count("*").cast("string").alias("value"))
    return env.where(F.col("key").rlike("click|[.]7$") | F.col("value").rlike("99")).orderBy("key")
