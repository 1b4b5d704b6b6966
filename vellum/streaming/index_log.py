"""A maintained index: stem counts of notes that come, change, move and go, as versions with tombstones.

A version has two tables: `counts` (path, stem, n, batch) and `marks`, one row for each note of its batch,
(path, mtime, gone, batch), with or without stems. A note's last mark, by mtime and then batch, names the
version that speaks for it; what other versions say of it is void, so an emptied note has a mark and no
stems, and a deleted or moved one a mark that it is gone. Compaction writes what is in force as a base, with
all marks, and removes the versions below it. A version is written whole before it counts, counts first and
marks last, and a batch that is run again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.index import stem_counts

COUNTS = "path string, stem string, n long, batch long"
MARKS = "path string, mtime long, gone boolean, batch long"


def files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The versions of a kind (batch or base) whose marks are written whole."""
    fs, at = files(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    found = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
    return sorted(n for n in found if fs.exists(files(spark, f"{folder}/{kind}={n}/marks/_SUCCESS")[1]))


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The folders in force: the newest base and the batches above it."""
    bases = numbers(spark, folder, "base")
    least = bases[-1] if bases else -1
    return [f"{folder}/base={least}"] * bool(bases) + [f"{folder}/batch={n}" for n in numbers(spark, folder, "batch") if n > least]


def read(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    found = [f"{part}/{table}" for part in parts(spark, folder)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def latest(marks: DataFrame) -> DataFrame:
    """(path, mtime, batch, gone): the last mark of each note."""
    last = marks.groupBy("path").agg(F.max(F.struct("mtime", "batch", "gone")).alias("m"))
    return last.select("path", "m.mtime", "m.batch", "m.gone")


def current_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime) of the notes that are there."""
    return latest(read(spark, folder, "marks", MARKS)).filter("not gone").select("path", "mtime")


def in_force(spark: SparkSession, folder: str) -> DataFrame:
    there = latest(read(spark, folder, "marks", MARKS)).filter("not gone").select("path", "batch")
    return read(spark, folder, "counts", COUNTS).join(there, ["path", "batch"], "left_semi")


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, n) of the notes that are there, each by its last version."""
    return in_force(spark, folder).select("path", "stem", "n")


def add_batch(notes: DataFrame, folder: str, number: int, lang: str = "en") -> None:
    """Writes a batch of notes (path, mtime, content, and gone where some are deleted) as one version.

    Of several rows of a path the one with the greatest mtime counts. A move is two rows: the old path gone,
    the new path with its content.
    """
    rows = notes if "gone" in notes.columns else notes.withColumn("gone", F.lit(False))
    rows = rows.select("path", F.struct("mtime", F.coalesce("gone", F.lit(False)).alias("gone"), "content").alias("s")).groupBy("path").agg(F.max("s").alias("s"))
    rows = rows.select("path", F.coalesce("s.mtime", F.lit(0)).cast("long").alias("mtime"), "s.gone", "s.content")
    at, batch = f"{folder}/batch={number}", F.lit(number).cast("long").alias("batch")
    stem_counts(rows.filter("not gone"), lang).select("path", "stem", "n", batch).write.mode("overwrite").parquet(f"{at}/counts")
    rows.select("path", "mtime", "gone", batch).write.mode("overwrite").parquet(f"{at}/marks")


def compact(spark: SparkSession, folder: str) -> None:
    """Writes what is in force as a base and removes the versions that it replaces; the last marks stay, so that an older row that comes late changes nothing."""
    batches, old = numbers(spark, folder, "batch"), numbers(spark, folder, "base")
    least = old[-1] if old else -1
    fresh = [n for n in batches if n > least]
    if fresh:
        to = f"{folder}/base={fresh[-1]}"
        in_force(spark, folder).select("path", "stem", "n", "batch").write.mode("overwrite").parquet(f"{to}/counts")
        latest(read(spark, folder, "marks", MARKS)).select("path", "mtime", "gone", "batch").write.mode("overwrite").parquet(f"{to}/marks")
    for kind, gone in (("batch", batches), ("base", old)):
        for n in gone:
            if kind == "batch" or fresh:
                fs, at = files(spark, f"{folder}/{kind}={n}")
                fs.delete(at, True)


def maintain_index(stream: DataFrame, folder: str, checkpoint: str, lang: str = "en", every: int = 10):
    """Keeps the index of a stream of notes: a version for each batch, compacted after every so many."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bases = numbers(spark, folder, "base")
        if bases and number <= bases[-1]:  # a batch run again after its version went into a base
            return
        add_batch(batch, folder, number, lang)
        if len(parts(spark, folder)) > every:
            compact(spark, folder)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
