"""Ranked full-text search: BM25 over stems, title matches, fusion by rank, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import BARS
from vellum.functions.text import FRONTMATTER, TOKEN, clean, counted, stem, tokens
from vellum.operators.index import NoteIndex, Postings, lengths, stem_bucket
from vellum.storage import small_batches

#: Width of a snippet and its run-up before the first match.
WIDTH, LEAD = 170, 50
PIECES = "array<struct<text:string,hit:boolean>>"


def split_scope(raw: Column) -> Column:
    """(query, scope): the last path: token as a lower-case prefix without leading slashes, and the rest of the query."""
    token = r"(?i)(?:^|\s)path:(\S+)"
    last = F.try_element_at(F.regexp_extract_all(raw, F.lit(token), F.lit(1)), F.lit(-1))
    scope = F.regexp_replace(F.lower(F.coalesce(last, F.lit(""))), "^/+", "")
    return F.struct(F.trim(F.regexp_replace(F.regexp_replace(raw, token, " "), r"\s+", " ")).alias("query"), scope.alias("scope"))


def in_scope(path: Column, scope: str) -> Column:
    return F.lower(path).startswith(scope.lower()) if scope else F.lit(True)


def terms(index: NoteIndex, query: str) -> DataFrame:
    """(stem): the distinct stems of a query, by the rules of the index."""
    one = index.notes.sparkSession.range(1).select(F.explode(tokens(clean(F.lit(query)))).alias("t"))
    return one.filter(counted(F.col("t"), index.lang)).select(stem(F.col("t"), index.lang).alias("stem")).distinct()


def leg(rows: DataFrame, limit: int, scope: str) -> DataFrame:
    """The first `limit` rows with a positive score in scope."""
    return rows.filter((F.col("score") > 0) & in_scope(F.col("path"), scope)).orderBy(F.col("score").desc(), "path").limit(limit)


def bm25(index: NoteIndex, query: str, limit: int = 50, scope: str = "") -> DataFrame:
    """(path, score). Only the postings of the query's stems are read; df and lengths count every note."""
    hits = index.counts.join(F.broadcast(terms(index, query)), "stem")  # as many rows as the query has stems
    df = hits.groupBy("stem").agg(F.count("*").alias("df"))
    sizes = lengths(index.notes, index.counts)
    whole = sizes.agg(F.count("*").alias("notes"), F.avg("len").alias("mean"))
    idf = F.log(1 + (F.col("notes") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    norm = F.col("n") + BARS.k1 * (1 - BARS.b + BARS.b * F.col("len") / mean)
    rows = hits.join(F.broadcast(df), "stem").join(sizes, "path").join(F.broadcast(whole))  # one row
    return leg(rows.groupBy("path").agg(F.sum(idf * F.col("n") * (BARS.k1 + 1) / norm).alias("score")), limit, scope)


def bm25_of_postings(postings: Postings, query_stems: list[str], limit: int = 50, scope: str = "") -> DataFrame:
    """bm25() over written postings: the scan is cut to the buckets of the query's stems, and in these to the stems."""
    spark = postings.rows.sparkSession
    asked = sorted(set(query_stems))
    if not asked:
        return postings.rows.select("path", F.lit(0.0).alias("score")).limit(0)
    of = spark.createDataFrame([(s,) for s in asked], "stem string").select(stem_bucket(F.col("stem"), postings.buckets).alias("b"))
    buckets = sorted({r["b"] for r in of.collect()})  # as many as the query has stems
    hits = postings.rows.filter(F.col("bucket").isin(buckets) & F.col("stem").isin(asked))
    df = hits.groupBy("stem").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(postings.notes) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("n") + BARS.k1 * (1 - BARS.b + BARS.b * F.col("len") / F.lit(postings.mean if postings.mean > 0 else 1.0))
    rows = hits.join(F.broadcast(df), "stem")  # as many rows as the query has stems
    return leg(rows.groupBy("path").agg(F.sum(idf * F.col("n") * (BARS.k1 + 1) / norm).alias("score")), limit, scope)


def title_hits(notes: DataFrame, query: str, limit: int = 50, scope: str = "") -> DataFrame:
    """(path, score): titles that hold the query, by the share that it covers."""
    q = query.strip().lower()
    if not q:
        return notes.select("path", F.lit(0.0).alias("score")).limit(0)
    title = F.lower("title")
    return leg(notes.filter(title.contains(q)).select("path", (F.lit(float(len(q))) / F.length(title)).alias("score")), limit, scope)


def fused(legs: list[DataFrame]) -> DataFrame:
    """(path, score): the sum over the legs of 1 / (60 + place). The legs are limited, so one task places each."""
    rows = None
    for i, part in enumerate(legs):
        part = part.select("path", "score", F.lit(i).alias("leg"))
        rows = part if rows is None else rows.unionByName(part)
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy("leg").orderBy(F.col("score").desc(), "path")))
    return placed.groupBy("path").agg(F.sum(1.0 / (BARS.rrf + F.col("rn"))).alias("score"))


def search(index: NoteIndex, query: str, limit: int = 50, scope: str = "") -> DataFrame:
    """(path, title, score) of the best notes by both legs; each leg gives twice the limit."""
    best = leg(fused([bm25(index, query, 2 * limit, scope), title_hits(index.notes, query, 2 * limit, scope)]), limit, scope)
    return index.notes.select("path", "title").join(F.broadcast(best), "path").select("path", "title", "score")  # at most `limit` rows


def flat(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), FRONTMATTER, ""), r"\s+", " "))


def query_terms(query: str) -> list[str]:
    word = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ'’-])*")
    return list(dict.fromkeys(t for t in word.findall(query.lower()) if len(t) >= 2))


def snippet_window(body: Column, query: str) -> Column:
    """The text around the first match, without marks."""
    text, first = flat(body), F.lit(None).cast("int")
    for t in query_terms(query):
        at = F.locate(t, F.lower(text))
        first = F.least(first, F.when(at > 0, at))
    start = F.greatest(F.coalesce(first - 1, F.lit(0)) - LEAD, F.lit(0))
    return F.substring(text, start + 1, F.lit(WIDTH))


def pieces_of(text: str, words: list[str], width: int = WIDTH) -> list[tuple[str, bool]]:
    """A snippet in pieces, marked or not, of one text without frontmatter and doubled spaces."""
    if not text:
        return []
    places = [i for i in (text.lower().find(w) for w in words) if i >= 0]
    start = max(0, min(places) - LEAD) if places else 0
    shown = text[start : start + width]
    marks = sorted(((m.start(), -m.end()) for w in words for m in re.finditer(re.escape(w), shown.lower())))
    out, at = [("…", False)] if start else [], 0
    for lo, hi in ((a, -b) for a, b in marks):
        if lo < at:
            continue
        out += [(shown[at:lo], False)] * (lo > at) + [(shown[lo:hi], True)]
        at = hi
    return out + [(shown[at:], False)] * (at < len(shown)) + [("…", False)] * (start + width < len(text))


def snippets(hits: DataFrame, notes: DataFrame, query: str) -> DataFrame:
    """(path, pieces) of the hits; no pieces where a body is missing. Only the hits' bodies are read."""
    words = query_terms(query)
    small_batches(notes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["pieces"] = [[{"text": t, "hit": h} for t, h in pieces_of(x, words)] for x in b["text"]]
            yield b[["path", "pieces"]]

    joined = notes.select("path", flat(F.col("content")).alias("text")).join(F.broadcast(hits.select("path")), "path", "right")
    return joined.select("path", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"path string, pieces {PIECES}")


__all__ = ["TOKEN", "bm25", "fused", "query_terms", "search", "snippet_window", "snippets", "split_scope", "title_hits"]
