"""Snapshot, journal, merge and sync queries over snapshots derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.operators import changes as ch
from lexistrata.operators.delta import delta_stats
from lexistrata.queries.common import Query, table
from lexistrata.sources import mail, storage
from lexistrata.sources.files import tree

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_A = "SELECT concat('./', lang, '/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, text AS content, doc_id * 60 AS mtime FROM documents WHERE doc_id % 17 <> 0"
_B = """SELECT CASE WHEN doc_id % 13 = 0 THEN concat('./moved/', CAST(doc_id AS STRING), '.txt') ELSE concat('./', lang, '/', source, '/', CAST(doc_id AS STRING), '.txt') END AS path,
CASE WHEN doc_id % 5 = 0 AND doc_id % 13 <> 0 THEN concat(text, ' EDITED') ELSE text END AS content,
doc_id * 60 + CASE WHEN doc_id % 5 = 0 AND doc_id % 13 <> 0 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 11 <> 0"""
#: The two snapshots as CTEs: some documents deleted, moved, edited and new between them.
SNAPSHOTS = f"snapshot_a AS ({_A}), snapshot_b AS ({_B})"


def _snapshot(sql: str) -> Query:
    def read(spark, d) -> DataFrame:
        return spark.sql(sql.replace("FROM documents", "FROM {docs}"), docs=table(spark, d, "documents"))

    return read


snapshot_a, snapshot_b = _snapshot(_A), _snapshot(_B)


def both(spark, d) -> tuple[DataFrame, DataFrame]:
    return snapshot_a(spark, d), snapshot_b(spark, d)


_W = f"WITH {SNAPSHOTS}, gone AS (SELECT * FROM snapshot_a WHERE path NOT IN (SELECT path FROM snapshot_b)), new AS (SELECT * FROM snapshot_b WHERE path NOT IN (SELECT path FROM snapshot_a))"
_MOVED = """, g AS (SELECT regexp_extract(path, '[^/]*$') AS base, * FROM gone), n AS (SELECT regexp_extract(path, '[^/]*$') AS base, * FROM new),
moved AS (SELECT g.path, n.path AS to_path, md5(g.content) AS digest, n.mtime FROM g JOIN n ON g.base = n.base AND strlen(g.content) = strlen(n.content) AND md5(g.content) = md5(n.content)
WHERE g.base IN (SELECT base FROM g GROUP BY base HAVING count(*) = 1) AND n.base IN (SELECT base FROM n GROUP BY base HAVING count(*) = 1))"""
_DIRS = ", dirs_{0} AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS path FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS k FROM snapshot_{0}))"
_CHANGED = ", diff AS (SELECT a.path, strlen(a.content) = 0 AS reclassified, md5(a.content) AS old, b.content, b.mtime FROM snapshot_a a JOIN snapshot_b b USING (path) WHERE a.mtime <> b.mtime)"
_JOURNAL = (
    _W + _MOVED + _CHANGED + _DIRS.format("a") + _DIRS.format("b")
    + """, deld AS (SELECT path FROM dirs_a WHERE path NOT IN (SELECT path FROM dirs_b)), newd AS (SELECT path FROM dirs_b WHERE path NOT IN (SELECT path FROM dirs_a)),
ops AS (SELECT 1 AS t, 'delete' AS type, path, NULL AS to_path, md5(content) AS digest, NULL AS content, NULL AS mtime FROM gone WHERE path NOT IN (SELECT path FROM moved)
UNION ALL SELECT 2, 'move', path, to_path, digest, NULL, mtime FROM moved
UNION ALL SELECT 3, 'create', path, NULL, md5(content), content, mtime FROM new WHERE path NOT IN (SELECT to_path FROM moved)
UNION ALL SELECT 3, 'create', path, NULL, md5(content), content, mtime FROM diff WHERE reclassified
UNION ALL SELECT 4, 'delta', path, NULL, old, content, mtime FROM diff WHERE NOT reclassified),
journal AS (SELECT row_number() OVER (ORDER BY t, path) - 1 AS seq, *, NULL::BOOLEAN AS created FROM ops
UNION ALL SELECT (SELECT count(*) FROM ops), 5, 'directory', path, NULL, NULL, NULL, NULL, created FROM (SELECT path, FALSE AS created FROM deld UNION ALL SELECT path, TRUE FROM newd))"""
)


@query("diff_deleted", f"{_W} SELECT path FROM gone")
def diff_deleted(spark, d):
    return ch.deleted(*both(spark, d)).select("path")


@query("diff_created", f"{_W} SELECT path FROM new")
def diff_created(spark, d):
    return ch.created(*both(spark, d)).select("path")


@query("diff_common", f"{_W} SELECT path FROM snapshot_a WHERE path IN (SELECT path FROM snapshot_b)")
def diff_common(spark, d):
    return ch.common(*both(spark, d))


@query("diff_dirs", _W + _DIRS.format("a") + _DIRS.format("b") + " SELECT path, a.path IS NULL AS created FROM dirs_a a FULL JOIN dirs_b b USING (path) WHERE a.path IS NULL OR b.path IS NULL".replace("a.path IS NULL AS created", "path NOT IN (SELECT path FROM dirs_a) AS created"))
def diff_dirs(spark, d):
    a, b = (ch.directories(s) for s in both(spark, d))
    return a.join(b, "path", "left_anti").withColumn("created", F.lit(False)).unionByName(b.join(a, "path", "left_anti").withColumn("created", F.lit(True)))


@query("diff_changed", _W + _CHANGED + " SELECT path, reclassified FROM diff")
def diff_changed(spark, d):
    return ch.changed(*both(spark, d))


@query("diff_moved", _W + _MOVED + " SELECT path, to_path, digest FROM moved")
def diff_moved(spark, d):
    return ch.moved(*both(spark, d)).select("path", "to_path", "digest")


@query("status_summary", _W + _MOVED + _CHANGED + " SELECT (SELECT count(*) FROM gone) - count(*) AS deleted, count(*) AS moved, (SELECT count(*) FROM new) - count(*) AS created, (SELECT count(*) FROM diff) AS changed FROM moved")
def status_summary(spark, d):
    s = ch.journal(*both(spark, d)).groupBy().agg(*[F.count_if(F.col("type") == t).alias(n) for t, n in (("delete", "deleted"), ("move", "moved"), ("create", "c"), ("delta", "e"))])
    empty = ch.changed(*both(spark, d)).where("reclassified").agg(F.count("*").alias("r"))
    return s.join(F.broadcast(empty)).select("deleted", "moved", (F.col("c") - F.col("r")).alias("created"), (F.col("e") + F.col("r")).alias("changed"))


@query("journal_build", f"{_JOURNAL} SELECT CAST(seq AS BIGINT) AS seq, type, path, to_path, digest, CAST(mtime AS BIGINT) AS mtime, created FROM journal")
def journal_build(spark, d):
    return ch.journal(*both(spark, d)).select(F.col("seq").cast("long").alias("seq"), "type", "path", "to_path", "digest", "mtime", "created")


@query("journal_payload", f"{_JOURNAL}, o AS (SELECT path, strlen(content) AS n FROM snapshot_a) SELECT type, count(*) AS rows, CAST(sum(CASE WHEN type = 'delta' THEN CASE WHEN n > 30 THEN 7 ELSE n + 7 END ELSE strlen(content) END) AS BIGINT) AS carried FROM journal LEFT JOIN o USING (path) WHERE type IN ('create', 'delta') GROUP BY type")
def journal_payload(spark, d):
    """Bytes of content that the operations carry: whole texts of new files, what deltas insert for changed ones."""
    j = ch.journal(*both(spark, d)).where("type in ('create', 'delta')")
    carried = F.when(F.col("type") == "delta", delta_stats(F.col("ops"))["insert_total"]).otherwise(F.octet_length("content"))
    return j.groupBy("type").agg(F.count("*").alias("rows"), F.sum(carried).alias("carried"))


@query("journal_scan", f"{_JOURNAL} SELECT CAST(seq AS BIGINT) AS seq, type, path FROM journal")
def journal_scan(spark, d):
    path = storage.scratch(spark, "journal")
    ch.journal(*both(spark, d)).write.json(path)
    return spark.read.schema("seq long, type string, path string").json(path)


@query("show_journal", f"{_JOURNAL} SELECT type || ' ' || path || CASE WHEN to_path IS NULL THEN '' ELSE ' -> ' || to_path END AS line FROM journal")
def show_journal(spark, d):
    return ch.journal(*both(spark, d)).select(F.concat(F.col("type"), F.lit(" "), F.col("path"), F.coalesce(F.concat(F.lit(" -> "), F.col("to_path")), F.lit(""))).alias("line"))


@query("journal_stats", f"{_JOURNAL} SELECT count(*) FILTER (WHERE type = 'move') AS moves, count(*) FILTER (WHERE type = 'create') AS creates, count(*) FILTER (WHERE type = 'delete') AS deletes, count(*) FILTER (WHERE type = 'delta') AS deltas, (SELECT count(*) FROM deld) AS deleted_directories, (SELECT count(*) FROM newd) AS created_directories FROM journal")
def journal_stats(spark, d):
    return ch.journal_stats(ch.journal(*both(spark, d)))


_C = """, state AS (SELECT concat('./', lang, '/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' LOCAL') ELSE text END AS content FROM documents WHERE doc_id % 7 <> 0)"""


def other_state(spark, d) -> DataFrame:
    """A third state: some files edited locally, some missing."""
    return _snapshot("SELECT concat('./', lang, '/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' LOCAL') ELSE text END AS content, doc_id * 60 AS mtime FROM documents WHERE doc_id % 7 <> 0")(spark, d)


_VERDICTS = (
    _JOURNAL + _C
    + """, sdirs AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS path FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS k FROM state)),
v AS (SELECT seq, type, j.path, CASE type
WHEN 'delete' THEN CASE WHEN s.path IS NULL THEN 0 WHEN md5(s.content) = digest THEN 1 ELSE -1 END
WHEN 'create' THEN CASE WHEN s.path IS NULL THEN 1 WHEN md5(s.content) = digest THEN 0 ELSE -1 END
WHEN 'move' THEN CASE WHEN s.path IS NOT NULL THEN CASE WHEN md5(s.content) = digest THEN 1 ELSE -1 END WHEN t.path IS NOT NULL THEN 0 ELSE -1 END
WHEN 'delta' THEN CASE WHEN s.path IS NOT NULL AND md5(s.content) = digest THEN 1 ELSE -1 END
END AS verdict
FROM journal j LEFT JOIN state s ON s.path = j.path LEFT JOIN state t ON t.path = j.to_path WHERE type <> 'directory'
UNION ALL SELECT seq, 'directory', '', CASE WHEN EXISTS (SELECT 1 FROM deld WHERE path IN (SELECT path FROM sdirs)) OR EXISTS (SELECT 1 FROM newd WHERE path NOT IN (SELECT path FROM sdirs)) THEN 1 ELSE 0 END FROM (SELECT DISTINCT seq FROM journal WHERE type = 'directory'))"""
)


def verdicts(spark, d) -> DataFrame:
    return ch.verdicts(ch.journal(*both(spark, d)), other_state(spark, d))


def _merge(kind: str) -> None:
    @query(f"merge_{kind}", f"{_VERDICTS} SELECT path, verdict FROM v WHERE type = '{kind}'")
    def merge(spark, d):
        return verdicts(spark, d).where(F.col("type") == kind).select("path", "verdict")


for _kind in ch.TYPES:
    _merge(_kind)


@query("merge_report", f"{_VERDICTS} SELECT count(*) FILTER (WHERE verdict = -1) AS conflicts, count(*) FILTER (WHERE verdict = 0) AS skips, count(*) FILTER (WHERE verdict = 1) AS applies, count(*) FILTER (WHERE verdict = -1) = 0 AND count(*) FILTER (WHERE verdict = 1) > 0 AS applicable FROM v")
def merge_report(spark, d):
    return ch.report(verdicts(spark, d))


@query("apply_test", f"{_JOURNAL}{_C} SELECT count(*) FILTER (WHERE NOT CASE WHEN type = 'create' THEN s.path IS NULL ELSE coalesce(md5(s.content) = digest, FALSE) END) AS failures, count(*) AS operations FROM journal j LEFT JOIN state s USING (path) WHERE type <> 'directory'")
def apply_test(spark, d):
    return ch.test_failures(ch.journal(*both(spark, d)), other_state(spark, d))


def _digests(df: DataFrame) -> DataFrame:
    return df.select("path", F.md5("content").alias("digest"))


@query("apply_changeset", f"WITH {SNAPSHOTS} SELECT path, md5(content) AS digest FROM snapshot_b")
def apply_changeset(spark, d):
    a, b = both(spark, d)
    return _digests(ch.apply_journal(a, ch.journal(a, b)))


@query("apply_undo_identity", f"WITH {SNAPSHOTS} SELECT path, md5(content) AS digest, CAST(mtime AS BIGINT) AS mtime FROM snapshot_a")
def apply_undo_identity(spark, d):
    """A stored changeset applied, then undone by the undo journal that is stored with it."""
    a, b = both(spark, d)
    path = storage.scratch(spark, "changeset")
    ch.write_changeset(a, b, path)
    there = ch.apply_journal(a, ch.read_changeset(spark, path))
    return ch.undo(there, path).select("path", F.md5("content").alias("digest"), "mtime")


@query("sync_new", f"{_W} SELECT path FROM new")
def sync_new(spark, d):
    a, b = both(spark, d)
    return ch.missing_elsewhere(b, a, "path").select("path")


@query("sync_publish", f"{_W} SELECT path FROM gone")
def sync_publish(spark, d):
    a, b = both(spark, d)
    return ch.missing_elsewhere(a, b, "path").select("path")


@query("verify_digests", f"WITH {SNAPSHOTS} SELECT a.path FROM snapshot_a a JOIN snapshot_b b USING (path) WHERE md5(a.content) <> md5(b.content)")
def verify_digests(spark, d):
    a, b = both(spark, d)
    return ch.broken_contents(a.join(b.select("path", F.md5("content").alias("digest")), "path")).select("path")


def written_tree(spark, d) -> str:
    """Files below a new folder: one for each language and source, and some in hidden folders and CVS."""
    root = storage.scratch(spark, "tree")
    docs = table(spark, d, "documents").select("lang", "source", F.col("text").alias("value"))
    docs.repartition("lang", "source").write.partitionBy("lang", "source").text(f"{root}/src")
    for hidden in (".hidden", "CVS", "src/x/.y"):
        docs.limit(1).select("value").coalesce(1).write.text(f"{root}/{hidden}")
    return root


_TREE = "SELECT './src/lang=' || lang || '/source=' || source AS folder, 1 AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents {} GROUP BY lang, source"


def _folders(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").cast("int").alias("files"), F.sum("size").alias("bytes"))


@query("tree_scan", _TREE.format(""))
def tree_scan(spark, d):
    """The visible files of a tree, from the listing alone."""
    return _folders(tree(spark, written_tree(spark, d), content=False))


@query("index_scan_excludes", _TREE.format("WHERE lang <> 'fr' AND source NOT LIKE '%1'"))
def index_scan_excludes(spark, d):
    return _folders(tree(spark, written_tree(spark, d), content=False, excludes=["/lang=fr/", "/source=[^/]*1/"]))


@query("doc_md5", "SELECT doc_id AS id, md5(text) AS digest FROM documents")
def doc_md5(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))


@query("mail_dedup", "WITH m AS (SELECT md5(rtrim(text, chr(10))) AS id, conv_id, role FROM conversations) SELECT id, min(conv_id) AS first_conv FROM m WHERE role = 'user' AND id NOT IN (SELECT id FROM m WHERE role = 'assistant') GROUP BY id")
def mail_dedup(spark, d):
    """Messages of a mailbox, each once, without those at hand already: written as mbox, read, parsed, told apart by content."""
    path = storage.scratch(spark, "mbox")
    turns = table(spark, d, "conversations")
    headers = F.concat(F.lit("Subject: turn\n "), F.col("turn").cast("string"), F.lit("\nX-Role: "), F.col("role"), F.lit("\nX-Conv: "), F.col("conv_id").cast("string"))
    turns.select(mail.mbox_row(headers, F.col("text")).alias("value")).write.text(path)
    read = mail.mbox(spark, path).select(F.md5("body").alias("id"), F.col("headers")["x-conv"].cast("long").alias("conv_id"), F.col("headers")["x-role"].alias("role"))
    new = read.where("role = 'user'").groupBy("id").agg(F.min("conv_id").alias("first_conv"))
    return new.join(read.where("role = 'assistant'").select("id"), "id", "left_anti")


@query("revision_index", f"{_JOURNAL} SELECT 'metadata' AS kind, NULL AS operation, 'changeset' AS path UNION ALL SELECT 'journal', type, path FROM journal UNION ALL SELECT 'data', type, path FROM journal WHERE content IS NOT NULL")
def revision_index(spark, d):
    """Documents of a changeset: one for its meta-data, one for each journal row, one for each piece of data."""
    j = ch.journal(*both(spark, d))
    meta = spark.createDataFrame([("metadata", None, "changeset")], "kind string, operation string, path string")
    kinds = F.when(F.col("content").isNull() & (F.coalesce(F.size("ops"), F.lit(0)) <= 0), F.array(F.lit("journal"))).otherwise(F.array(F.lit("journal"), F.lit("data")))
    return meta.unionByName(j.select(F.explode(kinds).alias("kind"), F.col("type").alias("operation"), "path"))
