"""Snapshots, their differences, operation journals, merge verdicts, application and undo.

A snapshot is (path, content, mtime). A journal row is (seq, type, path, to_path, digest, content, ops, mtime, created): an
operation carries its data, a delta where a file changed, so rows are independent and apply in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistrata.operators.delta import OPS, apply_deltas, make_deltas
from lexistrata.operators.ranking import with_rank
from lexistrata.sources.storage import materialized

#: Operation types in the order in which a changeset lists them.
TYPES = ["delete", "move", "create", "delta", "directory"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def visible(paths: DataFrame) -> DataFrame:
    """Paths without hidden files, files under hidden directories, and CVS."""
    below = F.regexp_replace(F.col("path"), r"^\./", "")
    return paths.where(~below.rlike(r"(^|/)\.[^/]") & ~below.rlike(r"(^|/)CVS(/|$)"))


def _described(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("path", F.octet_length("content").alias("size"), F.md5("content").alias("digest"), "mtime")


def deleted(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.join(target.select("path"), "path", "left_anti")


def created(source: DataFrame, target: DataFrame) -> DataFrame:
    return target.join(source.select("path"), "path", "left_anti")


def common(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.select("path").join(target.select("path"), "path", "left_semi")


def changed(source: DataFrame, target: DataFrame, by: str = "mtime") -> DataFrame:
    """path, reclassified (an empty source file counts as created), over common paths whose mtime (or md5) differs."""
    a = source.select("path", F.octet_length("content").alias("_size"), (F.col("mtime") if by == "mtime" else F.md5("content")).alias("_a"))
    b = target.select("path", (F.col("mtime") if by == "mtime" else F.md5("content")).alias("_b"))
    return a.join(b, "path").where("_a <> _b").select("path", (F.col("_size") == 0).alias("reclassified"))


def directories(snapshot: DataFrame) -> DataFrame:
    """All directories above the files."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return snapshot.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("path")).distinct()


def difference(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row for each path of either snapshot: path, kind (gone, new, changed, same), and size, digest and mtime on both sides.

    One join over descriptions; contents are not moved."""
    a = _described(source).select("path", F.lit(True).alias("_a"), *[F.col(c).alias(f"old_{c}") for c in ("size", "digest", "mtime")])
    b = _described(target).select("path", F.lit(True).alias("_b"), *[F.col(c).alias(f"new_{c}") for c in ("size", "digest", "mtime")])
    kind = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").when(F.col("old_mtime") != F.col("new_mtime"), "changed").otherwise("same")
    return a.join(b, "path", "full").withColumn("kind", kind).drop("_a", "_b")


def _moves(diff: DataFrame) -> DataFrame:
    """Moves among the rows of difference()."""

    def unique(kind: str, side: str, path: str) -> DataFrame:
        rows = diff.where(F.col("kind") == kind).groupBy(basename(F.col("path")).alias("base"))
        one = rows.agg(F.count("*").alias("n"), *[F.first(c).alias(n) for c, n in (("path", path), (f"{side}_size", "size"), (f"{side}_digest", "digest"), (f"{side}_mtime", f"{side}_mtime"))])
        return one.where("n = 1").drop("n")

    both = unique("gone", "old", "path").join(unique("new", "new", "to_path"), ["base", "size", "digest"])
    return both.select("path", "to_path", "digest", F.col("new_mtime").alias("mtime"))


def moved(source: DataFrame, target: DataFrame) -> DataFrame:
    """path, to_path, digest of files that are gone in one place and new in another: the basename occurs once among the deleted
    and once among the created, and size and md5 agree."""
    return _moves(difference(source, target))


_JOURNAL = ["seq", "type", "path", "to_path", "digest", "content", "ops", "mtime", "created"]


def journal(source: DataFrame, target: DataFrame) -> DataFrame:
    """The operations that turn source into target, numbered: deletes, moves, creates, deltas by path, then one for directories.

    A created file carries its content, a changed one the delta from its old content (ops; null where only the time differs).
    The directories' operation is one row for each directory, of one number, created or not.

    Paths are classed once (difference, written to the shared folder); contents are joined to the rows that need them, and
    numbers come from ranges of (type, path) that are sorted side by side."""
    diff = materialized(difference(source, target), "difference")
    moves = _moves(diff)
    text, none = F.lit(None).cast("string"), F.lit(None).cast(OPS)
    gone = diff.where("kind = 'gone'").join(moves.select("path", "to_path", "mtime"), "path", "left")
    gone = gone.select(F.when(F.col("to_path").isNull(), "delete").otherwise("move").alias("type"), "path", "to_path", F.col("old_digest").alias("digest"), text.alias("content"), none.alias("ops"), "mtime")
    new = diff.where("kind = 'new' or (kind = 'changed' and old_size = 0)").join(moves.select(F.col("to_path").alias("path")), "path", "left_anti")
    add = new.join(target.select("path", "content"), "path").select(F.lit("create").alias("type"), "path", text.alias("to_path"), F.col("new_digest").alias("digest"), "content", none.alias("ops"), F.col("new_mtime").alias("mtime"))
    edited = diff.where("kind = 'changed' and old_size > 0").select("path", "old_digest", "new_digest", "new_mtime")
    texts = edited.where("old_digest <> new_digest").join(source.select("path", F.col("content").alias("_old")), "path").join(target.select("path", F.col("content").alias("_new")), "path")
    made = make_deltas(texts, "_old", "_new").drop("_old", "_new").unionByName(edited.where("old_digest = new_digest").withColumn("ops", none))
    change = made.select(F.lit("delta").alias("type"), "path", text.alias("to_path"), F.col("old_digest").alias("digest"), text.alias("content"), "ops", F.col("new_mtime").alias("mtime"))
    ops = materialized(gone.unionByName(add).unionByName(change), "operations")
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    numbers = with_rank(ops.select("path", "type", rank.alias("_t")), [F.col("_t"), F.col("path")], "_r").select("path", "type", (F.col("_r") - 1).alias("seq"))
    files = ops.join(numbers, ["path", "type"]).withColumn("created", F.lit(None).cast("boolean")).select(_JOURNAL)
    da, db = directories(source), directories(target)
    dirs = da.join(db, "path", "left_anti").withColumn("created", F.lit(False)).unionByName(db.join(da, "path", "left_anti").withColumn("created", F.lit(True)))
    last = ops.agg(F.count("*").alias("seq"))  # one row
    dirs = dirs.join(F.broadcast(last)).select("seq", F.lit("directory").alias("type"), "path", text.alias("to_path"), text.alias("digest"), text.alias("content"), none.alias("ops"), F.lit(None).cast("long").alias("mtime"), "created")
    return files.unionByName(dirs)


def write_changeset(source: DataFrame, target: DataFrame, path: str) -> None:
    """The journal from source to target, and beside it the one that undoes it."""
    journal(source, target).write.parquet(f"{path}/journal")
    journal(target, source).write.parquet(f"{path}/undo")


def read_changeset(spark: SparkSession, path: str, undo: bool = False) -> DataFrame:
    return spark.read.parquet(f"{path}/undo" if undo else f"{path}/journal")


def undo(state: DataFrame, path: str) -> DataFrame:
    """The state before a stored changeset, by its stored undo journal; an error where there is none."""
    return apply_journal(state, read_changeset(state.sparkSession, path, True))


def journal_stats(ops: DataFrame) -> DataFrame:
    of = lambda t: F.count_if(F.col("type") == t)
    dirs = lambda made: F.count_if((F.col("type") == "directory") & (F.col("created") == made))
    return ops.agg(of("move").alias("moves"), of("create").alias("creates"), of("delete").alias("deletes"), of("delta").alias("deltas"), dirs(False).alias("deleted_directories"), dirs(True).alias("created_directories"))


def verdicts(ops: DataFrame, state: DataFrame, state_dirs: DataFrame | None = None) -> DataFrame:
    """seq, type, path, verdict of every operation against a state: -1 conflict, 0 skip, 1 apply.

    One pass: the state's digests join by path, and by the target of moves; directories are checked path by path and have one
    verdict for the operation they belong to."""
    have = state.select("path", F.md5("content").alias("_have"))
    target = state.select(F.col("path").alias("to_path"), F.lit(True).alias("_there"))
    rows = ops.where("type <> 'directory'").join(have, "path", "left").join(target, "to_path", "left")
    same, exists = F.col("_have") == F.col("digest"), F.col("_have").isNotNull()
    v = (
        F.when(F.col("type") == "delete", F.when(~exists, 0).when(same, 1).otherwise(-1))
        .when(F.col("type") == "create", F.when(~exists, 1).when(same, 0).otherwise(-1))
        .when(F.col("type") == "move", F.when(exists & same, 1).when(exists, -1).when(F.col("_there"), 0).otherwise(-1))
        .when(F.col("type") == "delta", F.when(exists & same, 1).otherwise(-1))
        .otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.col("type"))).cast("int"))
    )
    files = rows.select("seq", "type", "path", v.alias("verdict"))
    dirs = directories(state) if state_dirs is None else state_dirs
    found = ops.where("type = 'directory'").select("seq", "path", "created").join(dirs.select("path", F.lit(True).alias("_is")), "path", "left")
    need = found.groupBy("seq").agg(F.max(F.col("created") == F.col("_is").isNull()).alias("_need"))
    return files.unionByName(need.select("seq", F.lit("directory").alias("type"), F.lit("").alias("path"), F.when(F.col("_need"), 1).otherwise(0).alias("verdict")))


def report(checked: DataFrame) -> DataFrame:
    """conflicts, skips, applies and applicable (no conflict and something to apply), in one row."""
    r = checked.agg(F.count_if(F.col("verdict") == -1).alias("conflicts"), F.count_if(F.col("verdict") == 0).alias("skips"), F.count_if(F.col("verdict") == 1).alias("applies"))
    return r.withColumn("applicable", (F.col("conflicts") == 0) & (F.col("applies") > 0))


def test_failures(ops: DataFrame, state: DataFrame) -> DataFrame:
    """failures, operations: a dry run counts operations whose precondition does not hold in the state."""
    have = state.select("path", F.md5("content").alias("_have"))
    rows = ops.where("type <> 'directory'").join(have, "path", "left")
    fine = F.when(F.col("type") == "create", F.col("_have").isNull()).otherwise(F.coalesce(F.col("_have") == F.col("digest"), F.lit(False)))
    return rows.agg(F.count_if(~fine).alias("failures"), F.count("*").alias("operations"))


def apply_journal(state: DataFrame, ops: DataFrame) -> DataFrame:
    """The state after the operations. Paths of operations are disjoint, so one anti join removes and one union adds; moved
    content and the sources of deltas come from the state by an equi-join."""
    files = ops.where("type in ('delete', 'move', 'create', 'delta')")
    kept = state.join(files.select("path"), "path", "left_anti").select("path", "content", "mtime")
    put = files.where("type = 'create'").select("path", "content", "mtime")
    old = files.where("type in ('move', 'delta')").select("path", "type", "to_path", "ops", "mtime").join(state.select("path", "content"), "path")
    edited = F.when((F.col("type") == "move") | F.col("ops").isNull(), F.col("content")).otherwise(apply_deltas(F.col("content"), F.col("ops")).cast("string"))
    return kept.unionByName(put).unionByName(old.select(F.coalesce("to_path", "path").alias("path"), edited.alias("content"), "mtime"))


def missing_elsewhere(here: DataFrame, there: DataFrame, key: str = "id") -> DataFrame:
    """What is to fetch or publish: rows here whose key is not there."""
    return here.join(there.select(key), key, "left_anti").select(here.columns)


def broken_contents(contents: DataFrame) -> DataFrame:
    """Rows whose md5 is not the recorded digest."""
    return contents.where(F.md5("content") != F.col("digest"))
