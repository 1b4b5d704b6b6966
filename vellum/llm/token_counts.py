"""Token counts by a two-tier lookup on the map side.

A text's tokens are the sum of its pre-tokens' tokens. Tier one is a compact table, pre-token to number
of tokens, of the most frequent pre-tokens of a bounded sample of documents; it is broadcast and looked
up first, and is never emptied. Tier two is each worker's own cache: a pre-token that tier one misses is
looked up there, else encoded by the tokenizer library and kept, and the cache is emptied when full. No pre-token is ever shuffled. The sample decides what is
looked up quickly, never a result.

A text that the pattern might split otherwise than the library goes to the library whole: one with an
added token of the file in it, or with a code point that the two Unicode versions class differently.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of the sample, entries of the broadcast table, entries of a worker's table.
SAMPLE_DOCS, FREQUENT, WORKER_ENTRIES = 2000, 20_000, 500_000
#: Fixed value: the split pattern of byte-level BPE files with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counts(dict):
    """A worker's cache, pre-token to number of tokens; what is missing is encoded and kept."""

    def __init__(self, path: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normaliser or prefix space split by this pattern")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.split = regex.compile(PATTERN).findall
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = regex.compile("|".join(map(regex.escape, added))).search if added else lambda _: None
        self.ranges = regex.compile(r"[^\x00-\u0557]").search

    def __missing__(self, pre_token: str) -> int:
        if len(self) >= WORKER_ENTRIES:
            self.clear()
        n = self[pre_token] = len(self.library.encode(pre_token, add_special_tokens=False).ids)
        return n

    def count(self, text: str, frequent: dict[str, int]) -> int:
        if self.added(text) or self.ranges(text) and unassigned().search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        table = frequent if isinstance(frequent, Frequent) else Frequent(frequent, self)
        return sum(map(table.__getitem__, self.split(text)))


class Frequent(dict):
    """The broadcast table; what it misses is asked of the worker's cache and not kept here."""

    def __init__(self, table: dict[str, int], rest: Counts):
        super().__init__(table)
        self.rest = rest

    def __missing__(self, pre_token: str) -> int:
        return self.rest[pre_token]


@lru_cache(maxsize=1)
def unassigned():
    """Finds letters and numbers of the pattern's Unicode version that an older version leaves unassigned."""
    import regex

    new = [c for c in range(0x558, 0x110000) if unicodedata.category(chr(c)) == "Cn" and regex.match(r"[\p{L}\p{N}\s]", chr(c))]
    return regex.compile("[" + "".join(map(chr, new)) + "]") if new else regex.compile(r"(?!)")


@lru_cache(maxsize=2)
def load(path: str) -> Counts:
    return Counts(path)


def frequent_lengths(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS, entries: int = FREQUENT) -> dict[str, int]:
    """The broadcast tier: at most `entries` pre-tokens of at most `sample_docs` documents, with their lengths."""
    rows = max(1, docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = load(tokenizer), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(known.split(text or ""))
        top = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([known[p] for p in top], pa.int64())], ["p", "n"])

    sample = docs.select("text").sample(min(1.0, 1.2 * sample_docs / rows), 7).limit(sample_docs)
    return {r["p"]: r["n"] for r in sample.mapInArrow(run, "p string, n long").collect()}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every document.

    A null text counts as empty: no bytes, no tokens. Repeated rows give repeated rows. Other columns are left out.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(tokenizer)
        table = Frequent(frequent.value, known)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([known.count(t, table) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
