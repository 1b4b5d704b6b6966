"""Tables in the folder that driver and executors share, to end the lineage of iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Bytes up to which a scan is dealt to all cores.
SMALL = 4 << 30
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local folder, made once per application and removed at its end; only a local
    master may use one, as the executors of a cluster would each write to their own disk.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, _local[sc.applicationId], True)
    return _local[sc.applicationId]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_made: OrderedDict[tuple, object] = OrderedDict()
_locks: dict[tuple, threading.Lock] = {}
_guard = threading.Lock()
#: Results that once() remembers.
REMEMBERED = 16


def once(spark: SparkSession, key: tuple, make: Callable[[], T]) -> T:
    """What make() gives, made by the first caller of an application and key; others wait for it. The least recent of many is forgotten."""
    name = (spark.sparkContext.applicationId, *key)
    with _guard:
        lock = _locks.setdefault(name, threading.Lock())
    with lock:
        if name not in _made:
            found = make()
            with _guard:
                _made[name] = found
                while len(_made) > REMEMBERED:
                    _locks.pop(_made.popitem(last=False)[0], None)
        with _guard:
            if name in _made:
                _made.move_to_end(name)
                return _made[name]
    return once(spark, key, make)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table's folder, below the shared folder only."""
    if not path.startswith(f"{shared_folder(spark)}/"):
        raise ValueError(f"not in the shared folder: {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(scan: DataFrame) -> DataFrame:
    """A table's scan, dealt to all cores where its files give fewer tasks than that and hold at most SMALL bytes.

    A larger table is left as it is, however many cores there are: shuffling it whole would cost more.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    small = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL
    return scan.repartition(cores) if small and scan.rdd.getNumPartitions() < cores else scan


#: Rows that a Python worker gets at a time where a row holds a text, which may have 10^5 characters and more.
BATCH = 200


def small_batches(spark: SparkSession, rows: int = BATCH) -> None:
    """Arrow batches of at most so many rows, so that a worker's memory does not grow with its partition."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Bytes of a table's rows, uncompressed, up to which it is broadcast.
BROADCAST = 64 << 20


def width(df: DataFrame) -> Column:
    """The bytes of a row as the executors hold it: 8 for each field, and what strings, binaries and arrays take besides."""
    more = {"string": lambda c: F.octet_length(c), "binary": lambda c: F.octet_length(c), "array<bigint>": lambda c: 8 * F.size(c), "array<int>": lambda c: 8 * F.size(c)}
    parts = [F.lit(8 * len(df.columns))]
    for f in df.schema.fields:
        if (kind := f.dataType.simpleString()) in more:
            parts.append(F.coalesce(more[kind](F.col(f"`{f.name}`")), F.lit(0)))
    return reduce(lambda x, y: x + y, parts).cast("long")


def fits(table: DataFrame) -> bool:
    """Whether the table's rows, measured, are small enough to be broadcast. Give a written table: it is read for this."""
    return (table.agg(F.sum(width(table)).alias("s")).first()["s"] or 0) <= BROADCAST


def sized(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows, measured, are small; else the join shuffles. Give a written table: it is read twice."""
    return F.broadcast(table) if fits(table) else table
