"""Grep, title mentions and links inserted in bulk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.markdown import CLOSED, spans_of
from vellum.storage import fits, kept, sized, small_batches

#: A text in pieces, one from each place where a mention may start to the next: for the index, at a letter or digit
#: that follows none; for links, after no word character or bracket.
INDEX_PIECE = r"[a-z0-9]+[^a-z0-9]*"
LINK_PIECE = r"(?s)[a-z0-9_\[]*[^a-z0-9_\[]|[a-z0-9_\[]+$"


def grep(notes: DataFrame, queries: list[str]) -> DataFrame:
    """(query, path, line, content): lines that hold a query, in any case; lines from 1, trimmed. A query listed twice counts twice."""
    lines = notes.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    wanted = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(q.lower()).alias("low")) for q in queries])
    hit = lines.withColumn("q", F.explode(F.filter(wanted, lambda q: F.lower(F.col("text")).contains(q["low"])))) if queries else lines.limit(0).withColumn("q", F.struct(F.lit("").alias("query"), F.lit("").alias("low")))
    return hit.select("q.query", "path", (F.col("at") + 1).alias("line"), F.trim("text").alias("content"))


def grouped(found: DataFrame) -> DataFrame:
    """(query, path, matches array<struct<line, content>>) of grep rows."""
    return found.groupBy("query", "path").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("matches"))


def unique_titles(notes: DataFrame) -> DataFrame:
    """(title): titles that exactly one note has."""
    return notes.groupBy("title").agg(F.count("*").alias("n")).filter("n = 1").select("title")


def cut(text: Column, piece: str) -> Column:
    return F.regexp_extract_all(text, F.lit(piece), F.lit(0))


def keyed_titles(titles: DataFrame, piece: str) -> DataFrame:
    """(title, low, pieces, key, size): titles of two characters or more by what their mentions start with.

    A title of several pieces starts with its whole first piece and a character of the next; one of a single piece may go
    on in the text, so only its first two characters are sure. A title that starts where no mention can is left out.
    """
    low = F.lower("title") if piece == LINK_PIECE else F.col("title")
    rows = titles.filter(F.length("title") >= 2).select("title", low.alias("low")).distinct().withColumn("p", cut(F.col("low"), piece))
    rows = rows.filter((F.size("p") > 0) & F.startswith(F.col("low"), F.get("p", F.lit(0))))
    pieces = F.size("p")
    key = F.when(pieces > 1, F.left("low", F.length(F.get("p", F.lit(0))) + 1)).otherwise(F.left("low", F.lit(2)))
    return rows.select("title", "low", pieces.alias("pieces"), key.alias("key"), F.length("low").alias("size"))


#: Characters up to which what is ahead of a start is cut whatever it is, and not by pieces.
AHEAD = 256


def ahead(body: Column, piece: str, pieces: int, size: int) -> Column:
    """For each start of a piece the text from there on, at least so many pieces and at most so many characters, or to the end."""
    if size <= AHEAD:
        return F.regexp_extract_all(body, F.lit(f"(?s)(?=(.{{1,{size}}}))(?:{piece})"), F.lit(1))
    p = cut(body, piece)
    return F.transform(p, lambda t, i: F.left(F.array_join(F.slice(p, i + 1, F.lit(pieces)), ""), F.lit(size)))


def mentions(notes: DataFrame, titles: DataFrame, piece: str = INDEX_PIECE) -> DataFrame:
    """(title, path): notes whose lower-case body holds a title from a start on; titles of two characters or more.

    The text ahead of a start is cut by one pattern; its keys, its first piece with the next character and its first two characters, are looked
    up for the lengths of the titles with that key; only these lengths are cut from the text, and what is cut meets the
    titles by equality. All lookups are broadcast where they are small, so what is cut and is no title never leaves its
    task; of titles too many for that, 64-bit hashes are. Bodies are dealt by path once, so a note's repeated mentions
    are dropped where they are found. No start is held against each title of its key.
    """
    keyed = kept(keyed_titles(titles, piece), "titles")
    most = keyed.agg(F.max("pieces").alias("m"), F.max("size").alias("s")).first()
    if most["m"] is None:
        return notes.select(F.lit("").alias("title"), "path").limit(0)
    bodies = notes.select("path", "content").repartition("path").select("path", F.lower(F.coalesce("content", F.lit(""))).alias("body"))
    sizes = kept(keyed.groupBy((F.col("pieces") > 1).alias("several"), "key").agg(F.collect_set("size").alias("sizes")), "title-sizes")
    starts = bodies.select("path", F.explode(ahead(F.col("body"), piece, most["m"], most["s"])).alias("text"))
    long, short = (sized(sizes.filter(F.col("several") == several).select(F.col("key").alias(key), F.col("sizes").alias(f"{key}_sizes"))) for several, key in ((True, "whole"), (False, "two")))
    starts = starts.withColumns({"whole": F.left("text", F.length(F.regexp_extract("text", piece, 0)) + 1), "two": F.left("text", F.lit(2))}).join(long, "whole", "left").join(short, "two", "left")
    none = F.array().cast("array<int>")
    starts = starts.filter("whole_sizes is not null or two_sizes is not null").select("path", "text", F.explode(F.array_union(F.coalesce("whole_sizes", none), F.coalesce("two_sizes", none))).alias("size"))
    grams = starts.filter(F.length("text") >= F.col("size")).select("path", F.left("text", F.col("size")).alias("low"))
    known = keyed.select("title", "low")
    if not fits(known):
        hashes = kept(known.select(F.xxhash64("low").alias("h")).distinct(), "title-hashes")
        grams = grams.withColumn("h", F.xxhash64("low")).join(sized(hashes), "h", "left_semi").select("path", "low").distinct()
    return grams.join(sized(known), "low").select("title", "path").distinct()


def mention_index(notes: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, paths): the inverted index of mentions()."""
    return mentions(notes, titles).groupBy("title").agg(F.sort_array(F.collect_set("path")).alias("paths"))


#: What may not stand before a mention and what not behind it.
BEFORE, BEHIND = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_["), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_]")


def plain(text: str) -> bool:
    """Whether any case of the text is told by its lower case, letter for letter: not so of long s, final sigma, dotless i and their like."""
    rest = text.replace("ß", "")
    return len(text.lower()) == len(text) and rest.casefold() == rest.lower() and not any(c in text for c in "\u0131\u0130\u212a")


def found_plain(body: str, low: str, title: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the mentions of a plain title in a plain body, low its lower case: those that found_any() gives, without a pattern for each title."""
    title, at = title.lower(), 0
    while (at := low.find(title, at)) >= 0:
        end = at + len(title)
        if (at and body[at - 1] in BEFORE) or (end < len(body) and body[end] in BEHIND):
            at += 1
            continue
        yield at, end
        at = end


def found_any(body: str, title: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the mentions of a title in any case."""
    for m in re.finditer(rf"(?<![A-Za-z0-9_\[]){re.escape(title)}(?![A-Za-z0-9_\]])", body, re.I):
        yield m.start(), m.end()


def linked_body(body: str, own: str, titles: list[str]) -> tuple[str, list[str]]:
    """The body with the first free mention of each title as a link, longest titles first, and the titles linked."""
    known, found = {own.lower()}, spans_of(body)
    for s in (s for s in found if s["kind"] == "link"):
        target = s["target"]
        known |= {target.lower(), re.sub(r"\.md$", "", target.split("/")[-1]).lower(), (s["shown"] or target).lower()}
    taken = [(s["lo"], s["hi"]) for s in found if s["kind"] in CLOSED]
    added, low, simple = [], body.lower(), plain(body)
    for title in sorted(titles, key=lambda t: (-len(t), t)):
        if len(title) < 2 or title.lower() in known:
            continue
        simple_title = plain(title)
        for start, end in found_plain(body, low, title) if simple and simple_title else found_any(body, title):
            if any(a < end and start < b for a, b in taken):
                continue
            link = f"[[{title}]]"
            shift = len(link) - (end - start)
            taken = [(a + shift, b + shift) if a >= end else (a, b) for a, b in taken] + [(start, start + len(link))]
            body = body[:start] + link + body[end:]
            low, simple = low[:start] + link.lower() + low[end:], simple and simple_title
            added.append(title)
            known.add(title.lower())
            break
    return body, added


def autolink(notes: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(path, content, added array<string>) of every note; titles: the unique titles of the notes unless given.

    Each note is rewritten with the titles that it mentions only, so no task holds all titles.
    """
    mentioned = mentions(notes, unique_titles(notes) if titles is None else titles, LINK_PIECE)
    per_note = mentioned.groupBy(F.col("path").alias("_p")).agg(F.sort_array(F.collect_set("title")).alias("titles"))
    joined = notes.join(per_note, notes["path"] == per_note["_p"], "left").select("path", "title", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))
    small_batches(notes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [linked_body(c, t or "", list(ts)) for c, t, ts in zip(b["content"], b["title"], b["titles"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "content": [d[0] for d in done], "added": [d[1] for d in done]})

    return joined.mapInPandas(run, "path string, content string, added array<string>")


def autolink_note(notes: DataFrame, path: str, titles: DataFrame | None = None) -> DataFrame:
    """autolink() of one note with the titles given, else the unique titles of all notes; no row where there is no such note."""
    titles = unique_titles(notes) if titles is None else titles
    return autolink(notes.filter(F.col("path") == path), titles)


def autolink_totals(linked: DataFrame) -> DataFrame:
    """(notes, links): notes that autolink changed and links it added."""
    return linked.agg(F.count_if(F.size("added") > 0).alias("notes"), F.coalesce(F.sum(F.size("added")), F.lit(0)).alias("links"))
