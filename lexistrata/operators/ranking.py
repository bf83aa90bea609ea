"""Ranks over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistrata.sources.storage import materialized


def ranged(df: DataFrame, order: list[Column], buckets: int | None = None) -> DataFrame:
    """df with `_range`, the number of its range in the given order.

    Range borders come from a sample, so the dealt rows are written once: whatever reads them sees the same ranges, also after
    a lost executor."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialized(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def with_rank(df: DataFrame, order: list[Column], name: str, buckets: int | None = None) -> DataFrame:
    """df with the rank (from 1) of every row: row numbers inside ranges plus the sizes of the ranges before, one row each."""
    rows = ranged(df, order, buckets)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_range_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_range_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_range_off"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_range_row", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_range_row") + F.col("_range_off")).drop("_range", "_range_row", "_range_off")
