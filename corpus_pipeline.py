"""Documents to training rows: toxicity, near-duplicates, personal data, source mix, pieces.

Each stage takes what the stage before kept, all of it, and its decisions take effect: toxic documents
go; of near-duplicates the document with the smallest doc_id stays; personal data is replaced by its
kind; a document is repeated as often as the mix takes it, or goes; texts are encoded, and decoded again
as a check. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import mixing, near_copies, pieces, pii, toxicity
from vellum.llm.common import ship, small_batches, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose probability of being toxic reaches the model's threshold; labels are those of sf_dir."""
    ship(spark)
    small_batches(spark)
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that chains over five-word shingle similarities of 0.8 or more, the one with the smallest doc_id."""
    ship(spark)
    small_batches(spark)
    return near_copies.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by [EMAIL], [IP], [CARD] or [PHONE]; n_chars follows the text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it; documents without words stay once."""
    ship(spark)
    small_batches(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, pieces, n_pieces and round_trip, whether the pieces decode to the text again."""
    ship(spark)
    small_batches(spark)
    return pieces.with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "lang", "source", "pieces", "n_pieces", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has neither the models nor the rounding; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
