"""Line dedup by levelled sorted runs of line hashes.

A run is a table (key, docs), bucketed and sorted by key: the 128-bit hash of a line's key, and in how many
documents of its batches it stands. Documents come in batches. A batch's keys are counted into a sorted
table; keys that an earlier run has settled, that is seen in `least` documents, are anti-joined away and
the rest is a new run of level 0. The settled keys of the batch are kept apart, so that counts stay whole.
FAN runs of a level are compacted into one of the next. Buckets agree, so these are merge joins of sorted
tables without a shuffle; a batch meets as many runs as there are levels times FAN.

To drop lines, each document's distinct keys meet the common ones (very common keys are joined apart, by
a broadcast of a bounded number), and what is found goes back to its document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vellum.llm.common import hot_join, parallelism, written
from vellum.storage import removed, shared_folder

LEAST, MIN_CHARS = 10, 1
#: Batches that a table's files are dealt to, runs of a level, keys that a task counts before it sends them on.
BATCHES, FAN, HELD = 4, 2, 400_000


def keys_of(text: bytes, min_chars: int) -> list[bytes]:
    """The key of each line: bytes.strip and lower touch ASCII only, as the definition does; None for one that is too short."""
    keys = [line.strip(b" \t\n\x0b\x0c\r").lower() for line in text.split(b"\n")]
    long_enough = lambda k: len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars)
    return [xxhash.xxh3_128_digest(k) if long_enough(k) else None for k in keys]


def batch_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, docs) of a batch: in how many rows a key stands; counted in the task first, so a common line sends few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = lambda held: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["key", "docs"])
        held: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                held.update(set(keys_of(text, min_chars)) - {None})
                if len(held) >= HELD:
                    yield send(held)
                    held = Counter()
        if held:
            yield send(held)

    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "key binary, docs long")
    return rows.repartition(parallelism(docs.sparkSession), "key").groupBy("key").agg(F.sum("docs").alias("docs"))


class LineRuns:
    """The runs of the batches so far. close() removes their tables; what common() and totals() gave stays readable."""

    def __init__(self, spark: SparkSession, least: int = LEAST, min_chars: int = MIN_CHARS, fan: int = FAN):
        if least < 1 or min_chars < 1 or fan < 2:
            raise ValueError("a key is common in one document or more, has a character or more, and two runs or more are compacted")
        self.spark, self.least, self.min_chars, self.fan = spark, least, min_chars, fan
        self.parts = parallelism(spark)
        self.levels: list[list[str]] = []
        self.late: list[str] = []

    def sorted_table(self, rows: DataFrame) -> str:
        name = f"vellum_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.parts, "key").sortBy("key").option("path", f"{shared_folder(self.spark)}/runs/{name}").saveAsTable(name, format="parquet")
        return name

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            removed(self.spark, f"{shared_folder(self.spark)}/runs/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, docs: DataFrame) -> None:
        """Takes a batch of documents in."""
        came = self.sorted_table(batch_counts(docs, self.min_chars))
        settled = [self.spark.table(r).filter(F.col("docs") >= self.least).select("key") for r in self.runs()]
        if settled:
            new = reduce(lambda rows, s: rows.join(s.hint("merge"), "key", "left_anti"), settled, self.spark.table(came))
            old = [self.spark.table(came).join(s.hint("merge"), "key", "left_semi") for s in settled]
            # a key may be settled in several runs: the first one takes it
            old = [reduce(lambda rows, s: rows.join(s.hint("merge"), "key", "left_anti"), settled[:i], rows) for i, rows in enumerate(old)]
            run = self.sorted_table(new)
            self.late.append(self.sorted_table(reduce(DataFrame.unionByName, old)))
            self.drop([came])
        else:
            run = came
        self.push(run, 0)

    def push(self, run: str, level: int) -> None:
        """A run into its level; a full level is compacted into the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            full, self.levels[level] = self.levels[level], []
            merged = self.sorted_table(self.merged(full))
            self.drop(full)
            self.push(merged, level + 1)

    def merged(self, names: list[str]) -> DataFrame:
        """(key, docs): sorted tables merged into one, counts added."""
        zero = F.lit(0).cast("long")
        both = lambda a, b: a.hint("merge").join(b.withColumnRenamed("docs", "more"), "key", "full_outer").select("key", (F.coalesce("docs", zero) + F.coalesce("more", zero)).alias("docs"))
        return reduce(both, [self.spark.table(n) for n in names])

    def totals(self) -> DataFrame:
        """(key, docs): every key with the number of documents of all batches that have it."""
        names = self.runs() + self.late
        return self.merged(names) if names else self.spark.createDataFrame([], "key binary, docs long")

    def common(self) -> DataFrame:
        """(key, docs) of the keys in `least` documents or more, written."""
        return written(self.totals().filter(F.col("docs") >= self.least), "common-lines")

    def close(self) -> None:
        self.drop(self.runs() + self.late)
        self.levels, self.late = [], []


def batches_of(docs: DataFrame, most: int = BATCHES) -> list[DataFrame]:
    """A table's rows in up to `most` batches, by its files, so that none is read twice; any other frame is one batch."""
    files = sorted(docs.inputFiles())
    if len(files) < 2:
        return [docs]
    return [docs.sparkSession.read.schema(docs.schema).parquet(*files[i::most]) for i in range(min(most, len(files)))]


def dropped(docs: DataFrame, common: DataFrame, min_chars: int = MIN_CHARS, digest: bool = False) -> DataFrame:
    """docs without the lines whose key is in common (key, docs), with n_lines and n_dropped; with digest, kept_sha256 in place of the text."""
    names = unused(docs, "_row", "_wide", "_keys")
    row, wide, found = names
    marked = docs.withColumns({row: F.xxhash64("doc_id", "text"), wide: F.xxhash64(F.lit("wide"), "text", "doc_id")})

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                own = set(keys_of(text, min_chars)) - {None}
                keys += own
                at += [i] * len(own)
                if len(keys) >= HELD:
                    yield sent(b, at, keys)
                    at, keys = [], []
            yield sent(b, at, keys)

    def sent(b: pa.RecordBatch, at: list[int], keys: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary())], ["a", "b", "key"])

    lines = marked.select(row, wide, F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(every, "a long, b long, key binary")
    met = hot_join(lines, common, "key", "docs", "left_semi")
    # equal rows tell the same: a key counts once for all of them, and how many they are is told by any of their keys
    each = met.groupBy("a", "b", "key").agg(F.count("*").alias("rows"))
    per_row = written(each.groupBy(F.col("a").alias(row), F.col("b").alias(wide)).agg(F.collect_list("key").alias(found), F.max("rows").alias("rows")), "found-lines")
    joined = hot_join(marked, per_row, [row, wide], "rows", "left").select(*docs.columns, found)
    text_at, found_at = docs.columns.index("text"), len(docs.columns)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, gone = [], [], []
            for text, keys in zip(b.column(text_at).cast(pa.binary()).to_pylist(), b.column(found_at).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                stay = lines
                if keys:
                    of = set(keys)
                    stay = [line for line, key in zip(lines, keys_of(text, min_chars), strict=True) if key not in of]
                left = b"\n".join(stay)
                texts.append(hashlib.sha256(left).hexdigest() if digest else left if keys else text)
                sizes.append(len(lines))
                gone.append(len(lines) - len(stay))
            column = pa.array(texts, pa.string()) if digest else pa.array(texts, pa.binary()).cast(pa.string())
            rest = [column if i == text_at else b.column(i) for i in range(found_at)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], renamed)

    fields = [StructField("kept_sha256", StringType()) if digest and f.name == "text" else f for f in docs.schema.fields]
    out = StructType([*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    renamed = out.names
    return joined.mapInArrow(kept, out)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def deduplicated(docs: DataFrame, least: int = LEAST, min_chars: int = MIN_CHARS, batches: list[DataFrame] | None = None, digest: bool = False) -> DataFrame:
    """docs without the lines whose key stands in `least` documents or more, with n_lines (before) and n_dropped.

    A key is the line without spaces and U+0009 to U+000D at its ends, A to Z in lower case; keys of fewer
    than min_chars code points stay. Each row is a document, whatever its doc_id, so equal rows count each. A
    null text is one empty line and stays null; a text whose lines all go is empty. Equality is that of
    128-bit hashes. n_lines and n_dropped take the place of columns of these names; all others stay.
    """
    docs = docs.drop("n_lines", "n_dropped")
    runs = LineRuns(docs.sparkSession, least, min_chars)
    for batch in batches if batches is not None else batches_of(docs):
        runs.add(batch.select("text"))
    common = runs.common()
    runs.close()
    return dropped(docs, common, min_chars, digest)


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    batches = batches_of(docs)
    return deduplicated(docs.select("doc_id", "text"), batches=batches, digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
