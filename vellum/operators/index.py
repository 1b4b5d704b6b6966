"""The note index as DataFrames: stem counts, lengths, top stems, stems that tell notes apart."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import BARS
from vellum.functions.text import clean, counted, in_folders, language_hits, stemmed, tokens
from vellum.storage import kept, once, shared_folder


@dataclass(frozen=True)
class NoteIndex:
    """notes (path, ..., excluded), counts (path, stem, n), top (path, stem, n, rn, size, excluded), disc (path, stem)."""

    notes: DataFrame
    counts: DataFrame
    top: DataFrame
    disc: DataFrame
    lang: str

    def persist(self) -> NoteIndex:
        """The same index with the two tables that every query reads kept by the executors."""
        return replace(self, top=self.top.persist(), disc=self.disc.persist())


#: Bytes of scanned files whose words one task counts.
COUNTED = 6 << 20


def words_of(notes: DataFrame) -> DataFrame:
    """(path, token) of each token. Bodies are dealt by path, so that what is counted of a note is counted where its words are, without another shuffle."""
    spark, bodies = notes.sparkSession, notes.select("path", "content")
    size = int(str(notes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // COUNTED if size < 1 << 50 else 0)  # beyond: not known
    return bodies.repartition(parts, "path").select("path", F.explode(tokens(clean(F.col("content")))).alias("token"))


def token_counts(notes: DataFrame) -> DataFrame:
    """(path, token, n): surface forms, before stop words and stems."""
    return words_of(notes).groupBy("path", "token").agg(F.count("*").alias("n"))


def stem_counts(notes: DataFrame, lang: str = "en") -> DataFrame:
    """(path, stem, n)."""
    words = words_of(notes).filter(counted(F.col("token"), lang))
    return stemmed(words, lang).groupBy("path", "stem").agg(F.count("*").alias("n"))


def detect_language(notes: DataFrame) -> DataFrame:
    """(lang): the language with most stop words in the first eight notes, excluded ones last; English at a tie."""
    first = notes.orderBy("excluded", "path").limit(8)
    joined = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("excluded", "path", "content"))), lambda s: s["content"]), "\n").alias("text"))
    hits = joined.select(language_hits(clean(F.coalesce("text", F.lit("")))).alias("h"))
    return hits.select(F.when(F.col("h.it") > F.col("h.en"), "it").otherwise("en").alias("lang"))


def lengths(notes: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, len): counted tokens of every note, zero where there is none."""
    sums = counts.groupBy("path").agg(F.sum("n").alias("len"))
    return notes.select("path").join(sums, "path", "left").select("path", F.coalesce("len", F.lit(0)).alias("len"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("stem").agg(F.count("*").alias("df"))


def top_stems(counts: DataFrame, k: int = BARS.top_k) -> DataFrame:
    """(path, stem, n, rn, size): the k commonest stems of each note, ties by stem; size: how many a note has."""
    by = Window.partitionBy("path")
    ranked = counts.withColumn("rn", F.row_number().over(by.orderBy(F.col("n").desc(), "stem"))).filter(F.col("rn") <= k)
    return ranked.withColumn("size", F.count("*").over(by).cast("int"))


def discriminating(notes: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, stem) without the stems that are common: in more than a quarter of the notes, from 20 notes on."""
    n = notes.agg(F.count("*").alias("notes"))
    df = document_frequency(counts).join(F.broadcast(n))  # one row: the number of notes
    common = df.filter((F.col("notes") >= BARS.common_notes) & (F.col("df") >= BARS.common_docs) & (F.col("df") / F.col("notes") > BARS.common_share)).select("stem")
    # each common stem is in over a quarter of the notes, so there are at most four times the stems of a mean note: few enough to be broadcast
    return counts.select("path", "stem").join(F.broadcast(common), "stem", "left_anti").select("path", "stem")


def marked(notes: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """notes with excluded: whether they are in one of the folders."""
    return notes.withColumn("excluded", in_folders(F.col("path"), list(exclude)))


def build(notes: DataFrame, exclude: list[str] = (), lang: str | None = None) -> NoteIndex:
    """The index of the notes. The language is detected unless given, and stays the index's own."""
    notes = marked(notes, exclude)
    lang = lang or detect_language(notes).first()["lang"]
    counts = kept(stem_counts(notes, lang), "counts")  # every other table starts from it
    top = kept(top_stems(counts).withColumn("excluded", in_folders(F.col("path"), list(exclude))), "top")
    return NoteIndex(notes, counts, top, kept(discriminating(notes, counts), "disc"), lang)


def version(notes: DataFrame, *columns: str) -> tuple:
    """What tells one state of a table from another: its number of rows and the sum of the hashes of some of its columns."""
    state = notes.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return state["n"], state["h"]


def shared(key: str, notes: DataFrame, exclude: list[str] = (), lang: str | None = None) -> NoteIndex:
    """The index of the notes that `key` names, one for an application, a version of the notes and the settings.

    The first caller builds its tables, later ones read them, callers at the same time wait; the version is
    told by paths and mtimes, so a note whose text changed under its old mtime is not seen, as in refresh().
    """
    return once(notes.sparkSession, ("index", key, *version(notes, "path", "mtime"), tuple(exclude), lang), lambda: build(notes, exclude, lang))


@dataclass(frozen=True)
class Postings:
    """rows (bucket, stem, path, n, len) in folders by bucket, a bucket being a hash of the stem; notes and mean length of the index."""

    rows: DataFrame
    buckets: int
    notes: int
    mean: float


def postings(index: NoteIndex, buckets: int = 64, spread_over: int = 4) -> Postings:
    """The counts by stem, with the length of each note: a search reads the buckets of its stems and nothing else.

    Inside a bucket rows are sorted by stem, so that row groups are skipped too. A bucket is written by
    several tasks, so that a stem of most notes is not in one.
    """
    sizes = kept(lengths(index.notes, index.counts), "lengths")
    whole = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    rows = index.counts.join(sizes, "path").withColumn("bucket", stem_bucket(F.col("stem"), buckets))
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(spread_over))).sortWithinPartitions("bucket", "stem")
    path = f"{shared_folder(index.notes.sparkSession)}/tables/postings-{uuid.uuid4().hex}"
    rows.select("bucket", "stem", "path", "n", "len").write.partitionBy("bucket").parquet(path)
    read = index.notes.sparkSession.read.schema("stem string, path string, n long, len long, bucket int").parquet(path)
    return Postings(read, buckets, whole["n"], whole["mean"] or 0.0)


def stem_bucket(of: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")


def top_set(index: NoteIndex, path: str) -> DataFrame:
    """(stem): the top stems of one note, no row for an unknown one."""
    return index.top.filter(F.col("path") == path).select("stem")


def refresh(old_notes: DataFrame, old_counts: DataFrame, notes: DataFrame, lang: str = "en") -> DataFrame:
    """(path, stem, n) of the notes: rows of a note are kept where path and mtime are as before, else counted anew."""
    same = notes.join(old_notes.select("path", "mtime"), ["path", "mtime"], "left_semi").select("path")
    stale = notes.join(old_notes.select("path", "mtime"), ["path", "mtime"], "left_anti")
    return old_counts.join(same, "path", "left_semi").unionByName(stem_counts(stale, lang))


def unchanged(old_notes: DataFrame, notes: DataFrame) -> bool:
    """Whether both have the same paths, mtimes and exclusions."""
    cols = [c for c in ("path", "mtime", "excluded") if c in notes.columns and c in old_notes.columns]
    a, b = old_notes.select(cols), notes.select(cols)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
