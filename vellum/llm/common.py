"""What the operators of this subpackage share: tables, shared storage, global ranks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.storage import fits, kept, sized, spread

#: Words and white space of the contracts: space and U+0009 to U+000D part words, nothing else.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the directory. Arrow batches are kept small: a text may have 10^5 characters and more."""
    ship(spark)
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    return kept(df, name)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot from so many rows on, and if it has over 1 / HOT_KEYS of all rows: there are at most HOT_KEYS such keys.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def hot_join(big: DataFrame, small: DataFrame, key: str | list[str], count: str, how: str = "inner") -> DataFrame:
    """big joined with small on key (inner, left or left_semi); small has one row per key and, in `count`, big's rows of it.

    Rows of hot keys meet a broadcast of small's rows, at most HOT_KEYS, and are not shuffled; all other
    rows are joined by a shuffle in which no key is hot. A small table whose measured rows fit is broadcast whole, so
    that the planner's guess does not decide how often big is shuffled. small is read several times: give a written table.
    """
    keys = [key] if isinstance(key, str) else key
    if fits(small):
        return big.join(F.broadcast(small.drop(count)), keys, how)
    total = small.agg(F.sum(count).alias("n")).first()["n"] or 0
    many = F.col(count) > max(HOT_ROWS, total / HOT_KEYS)
    hot, cold = small.filter(many).drop(count), small.filter(~many).drop(count)
    if not hot.limit(1).count():
        return big.join(small.drop(count), keys, how)
    rest = big.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return big.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner").unionByName(rest.join(cold, keys, how))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the column `name`: each row's rank from 1 in the given order over all rows, without a single task.

    Rows are dealt by range and ranked inside their range; the ranges' offsets, one number for each
    partition, are added. The order should be total, else ties are ranked arbitrarily.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    dealt = df.repartitionByRange(max(1, parallelism(spark)), *order).withColumn("_part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    kept = written(dealt.withColumn(name, inside.cast("long")), "numbered")
    sizes = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, at = {}, 0
    for part in sorted(sizes):
        offsets[part], at = at, at + sizes[part]
    if not offsets:
        return kept.drop("_part")
    shift = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return kept.withColumn(name, F.col(name) + shift[F.col("_part")].cast("long")).drop("_part")


def under_safe_names(docs: DataFrame, core: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) where all columns but the core ones have names of ours for the time, so none meets the stage's own working columns."""
    safe = [c if c in core else f"kept{i}" for i, c in enumerate(docs.columns)]
    back = dict(zip(safe, docs.columns, strict=True))
    out = stage(docs.toDF(*safe))
    return out.toDF(*[back.get(c, c) for c in out.columns])


def plain(df: DataFrame, column: str) -> Column:
    """The column in a form that can be hashed and ordered: JSON for what holds a map or a variant, else itself."""
    kind = df.schema[column].dataType.simpleString()
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else F.col(column)
