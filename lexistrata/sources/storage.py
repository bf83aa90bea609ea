"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_alone: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context was told. Where neither is set, a
    local master gets a temporary folder, one for each application; any other raises, as each executor would write to a disk of
    its own and what the driver reads back would be empty or partial."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _alone:
            _alone[app] = "file://" + tempfile.mkdtemp(prefix="lexistrata-")
        found = _alone[app]
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the cluster's own cleaning removes the folder
            return


atexit.register(_clean)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/lexistrata/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialized(df: DataFrame, label: str) -> DataFrame:
    """df written as parquet into the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration: each is written and read back, and lets the one before it go."""

    def __init__(self, label: str):
        self.label, self.path = label, None

    def next(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = scratch(spark, self.label)
        df.write.parquet(self.path)
        if before:
            _delete(spark, before)
        return spark.read.schema(df.schema).parquet(self.path)


def spread(df: DataFrame) -> DataFrame:
    """df itself, unless its files give fewer splits than there are cores: then its rows are dealt over the cores. Only small
    inputs (a file or two) are ever moved by this; larger ones have more splits than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
