"""Ranks and predecessors inside keys of which one may hold most rows: dealt by range, so no task holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.storage import kept


def dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df by ranges of the keys and the order, with each row's range in _part; written, as ranges are drawn from a sample."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(max(1, parts), *keys, *order).withColumn("_part", F.spark_partition_id()), "dealt")


def of_range(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what ends says of their keys and range; a null key is a key."""
    there = ends.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_range"), "_carry")
    same = rows["_part"] == there["_range"]
    for i, k in enumerate(keys):
        same &= rows[k].eqNullSafe(there[f"_{i}"])
    return rows.join(there, same, "left").drop("_range", *[f"_{i}" for i in range(len(keys))])


def rank_within(df: DataFrame, name: str, keys: list[str], order: list[Column]) -> DataFrame:
    """df with the column `name`: each row's rank from 1 among the rows of its keys. The order should be total."""
    rows = dealt(df, keys, order)
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.groupBy(*keys, "_part").agg(F.count("*").alias("n")).withColumn("_carry", before)  # a row for each range of a key
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    placed = rows.withColumn("_at", inside)
    return of_range(placed, ends, keys).withColumn(name, F.col("_at") + F.coalesce("_carry", F.lit(0))).drop("_part", "_at", "_carry")


def with_previous(df: DataFrame, name: str, column: str, keys: list[str], order: str) -> DataFrame:
    """df with the column `name`: `column` of the row before in the ascending order of its keys, null for the first."""
    rows = dealt(df, keys, [F.col(order)])
    last = F.last("_last").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.groupBy(*keys, "_part").agg(F.max_by(column, order).alias("_last")).withColumn("_carry", last)
    inside = Window.partitionBy("_part", *keys).orderBy(order)
    placed = rows.withColumn("_at", F.row_number().over(inside)).withColumn("_lag", F.lag(column).over(inside))
    return of_range(placed, ends, keys).withColumn(name, F.when(F.col("_at") == 1, F.col("_carry")).otherwise(F.col("_lag"))).drop("_part", "_at", "_lag", "_carry")
