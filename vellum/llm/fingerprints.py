"""Canonical exact fingerprints, in DataFrame functions only.

The canonical text is the NFKC form, case folded, normalised again, with each run of Unicode white space
as one space and none at the ends. Its fingerprint is wide: two 64-bit xxhashes over different input.
Documents are grouped by fingerprint and canonical text together, pre-aggregated on the map side, so
inside an equal bucket the bytes are compared and each different text is a class of its own.

The next document in descending doc_id is found without a global order: ids are cut at quantiles into
ranges, each range is one window, and the first row of each range is copied to the range before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import parallelism, written


def canonical(text: Column) -> Column:
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)[\s\x{85}\x{A0}\x{2007}\x{202F}\x{FEFF}]+", " "))


def wide(canon: Column) -> Column:
    """32 hex digits of the canonical text."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0")))


def ranges(keys: DataFrame, n: int) -> tuple[Column, list[int], int]:
    """Of a frame with the column key: the range of a key (0 holds the largest), the largest key of each range, their number."""
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    row = keys.agg(F.percentile_approx("key", shares, 10_000).alias("q"), F.min("key").alias("lo")).first()
    cuts = sorted({c for c in row["q"] or [] if c != row["lo"]}, reverse=True)
    # two steps of about sqrt(n) comparisons each: which group of cuts, which cut in it
    step = max(1, int(len(cuts) ** 0.5))
    if not cuts:
        of = F.lit(0)
    else:
        coarse = F.lit(cuts[step - 1 :: step]).cast("array<bigint>")
        group = F.size(F.filter(coarse, lambda c: c > F.col("key")))
        near = F.slice(F.lit(cuts).cast("array<bigint>"), group * step + 1, F.lit(step))
        of = group * step + F.size(F.filter(near, lambda c: c > F.col("key")))
    heads = [r["m"] for r in keys.select("key", of.alias("range")).groupBy("range").agg(F.max("key").alias("m")).orderBy("range").collect()]
    return of, heads, len(heads)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document by descending doc_id, of the first one after the last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
    of, heads, n = ranges(rows.select("key"), parallelism(docs.sparkSession))
    own = rows.withColumn("range", of).withColumn("extra", F.lit(False))
    ahead = rows.filter(F.col("key").isin(heads)).withColumn("range", F.pmod(of - 1, F.lit(max(1, n)))).withColumn("extra", F.lit(True))
    order = Window.partitionBy("range").orderBy("extra", F.col("key").desc(), "text")
    dealt = own.unionByName(ahead).withColumn("next_text", F.lead("text").over(order))
    return dealt.filter(~F.col("extra")).select("doc_id", "text", "next_text")


def classes(docs: DataFrame, digest=wide) -> DataFrame:
    """(fingerprint, canon, class_id, copies): classes of equal canonical texts; canon only where a bucket holds several."""
    texts = docs.select("doc_id", canonical(F.col("text")).alias("canon"))
    texts = texts.select("doc_id", "canon", digest(F.col("canon")).alias("fingerprint"))
    equal = texts.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    found = written(equal.drop("canon"), "classes")
    several = written(found.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"), "several")
    if not several.limit(1).count():
        return found.withColumn("canon", F.lit(None).cast("string"))
    apart = equal.join(several, "fingerprint", "left_semi")
    return found.join(several, "fingerprint", "left_anti").withColumn("canon", F.lit(None).cast("string")).unionByName(apart)


def fingerprints(docs: DataFrame, digest=wide) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, copies of every document.

    The edited text replaces the last third of the code points by as many first ones (or all) of the next
    document. near_*: 1.0 if the fingerprints and the canonical bytes are equal, else 0.0. class_id is the
    smallest doc_id with the same canonical bytes, copies how many have them. A null text counts as empty;
    a document without doc_id comes last in the order; of equal ids the texts' order counts.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs).withColumn("edited", edited)
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("a"), canonical(F.col("edited")).alias("b"), canonical(F.col("next_text")).alias("c"))
    rows = rows.select("a", "doc_id", "n_chars", "edited_sha256", digest(F.col("a")).alias("fingerprint"), digest(F.col("b")).alias("edited_fingerprint"), (F.col("a") == F.col("b")).cast("double").alias("near_edited"), (F.col("a") == F.col("c")).cast("double").alias("near_next"))
    found = classes(docs, digest).withColumnsRenamed({"fingerprint": "f", "canon": "k"})
    same = F.col("fingerprint") == F.col("f")
    if found.filter("k is not null").limit(1).count():  # buckets with different texts: told apart by their bytes
        return rows.join(found, same & (F.col("k").isNull() | (F.col("k") == F.col("a"))), "left").drop("a", "f", "k")
    return rows.drop("a").join(found.drop("k"), same, "left").drop("f")
