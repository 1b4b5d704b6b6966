"""Line diffs and their algebra over columns of texts."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.storage import small_batches

#: Fixed value of all but accepting: above so many cells the changed middle is one block of removals, then additions.
MAX_CELLS = 2_000_000
LINES = "array<struct<op:string,text:string>>"
HUNKS = "array<struct<before_start:int,before_end:int,after_start:int,after_end:int,removed:array<string>,added:array<string>>>"


def lines_of(text: str) -> list[str]:
    return text.split("\n") if text else []


def grown(row: int, hits: int, full: int) -> int:
    """The row of the table of walk() before `row`, given where its line stands in the other text."""
    u = row & hits
    return (row + u | row - u) & full if u else row


def walk(p: np.ndarray, q: np.ndarray) -> Iterator[str]:
    """The ops that lead from the lines p to the lines q along a longest common subsequence, removals before additions.

    A row of the table of lengths is one integer: bit k of row i is 0 where q[-1 - k] makes the longest common subsequence of
    p[i:] and q longer. Every so manieth row is kept and those between are made anew on the way, so memory grows as
    len(q) * sqrt(len(p)) / 4 bytes at most.
    """
    n, m = len(p), len(q)
    full, back = (1 << m) - 1, q[::-1]
    hits = lambda i: int.from_bytes(np.packbits(back == p[i], bitorder="little").tobytes(), "little")
    step = math.isqrt(n) + 1
    row, kept = full, {n: full}
    for i in range(n - 1, -1, -1):
        row = grown(row, hits(i), full)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}
    i, j, length = 0, 0, m - row.bit_count()  # length: of the longest common subsequence of p[i:] and q[j:]
    while i < n and j < m:
        if p[i] == q[j]:
            yield " "
            i, j, length = i + 1, j + 1, length - 1
            continue
        if i + 1 not in rows:
            last = min(i // step * step + step, n)
            rows = {last: kept[last]}
            for k in range(last - 1, i, -1):
                rows[k] = grown(rows[k + 1], hits(k), full)
        below = rows[i + 1]
        rest = m - j - (below & (1 << m - j) - 1).bit_count()  # as length, of p[i + 1:]
        while j < m and p[i] != q[j] and rest < length:
            yield "+"
            rest -= ~below >> m - 1 - j & 1
            j += 1
        if j < m and p[i] != q[j]:
            yield "-"
            i += 1
    yield from "-" * (n - i) + "+" * (m - j)


def diff(before: str, after: str, most: int | None = MAX_CELLS) -> list[tuple[str, str]]:
    """(op, line) with op space, minus or plus; removals come before additions. most: cells above which the changed middle is one block; None for no such switch."""
    a, b = lines_of(before), lines_of(after)
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    same, x, y = [(" ", t) for t in a[:head]], a[head : len(a) - tail], b[head : len(b) - tail]
    end = [(" ", t) for t in a[len(a) - tail :]]
    if not x or not y or (most is not None and len(x) * len(y) > most):
        return same + [("-", t) for t in x] + [("+", t) for t in y] + end
    ids: dict[str, int] = {}
    p, q = (np.array([ids.setdefault(t, len(ids)) for t in side]) for side in (x, y))
    out, i, j = [], 0, 0
    for op in walk(p, q):
        out.append((op, y[j] if op == "+" else x[i]))
        i, j = i + (op != "+"), j + (op != "-")
    return same + out + end


def hunks(before: str, after: str, most: int | None = MAX_CELLS) -> list[dict]:
    """Runs of change with their line ranges on both sides, end exclusive: the islands of changed rows in the line column."""
    rows = diff(before, after, most)
    op = np.array([o for o, _ in rows], dtype=object)
    # how many lines of each side stand before a row
    a, b = (np.concatenate([[0], np.cumsum(op != other, dtype=np.int64)]) for other in ("+", "-"))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (op != " ").astype(int), [0]])))
    side = lambda lo, hi, which: [t for o, t in rows[lo:hi] if o == which]
    return [
        {"before_start": int(a[lo]), "before_end": int(a[hi]), "after_start": int(b[lo]), "after_end": int(b[hi]), "removed": side(lo, hi, "-"), "added": side(lo, hi, "+")}
        for lo, hi in edges.reshape(-1, 2).tolist()
    ]


def spliced(text: str, swaps: list[tuple[int, int, list[str]]]) -> str:
    """The text with line ranges [lo, hi) replaced; the ranges are in order and apart."""
    rows, out, at = lines_of(text), [], 0
    for lo, hi, new in swaps:
        out += [*rows[at:lo], *new]
        at = hi
    return "\n".join(out + rows[at:])


def accepted(before: str, h: dict) -> str:
    """The baseline with one hunk taken into it."""
    return spliced(before, [(h["before_start"], h["before_end"], list(h["added"]))])


def reverted(doc: str, found: list[dict]) -> str:
    """The text with the hunks put back."""
    return spliced(doc, [(h["after_start"], h["after_end"], list(h["removed"])) for h in found])


def rejection(after: str, h: dict) -> tuple[int, int, str]:
    """(from, to, insert): the edit of the text that puts a hunk's removed lines back, between what both texts share at their ends."""
    back = reverted(after, [h])
    head = len(os.path.commonprefix([after, back]))
    tail = len(os.path.commonprefix([after[head:][::-1], back[head:][::-1]]))
    return head, len(after) - tail, back[head : len(back) - tail]


def changed(h: dict) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """What a hunk takes and gives, by which hunks of different texts are told to be the same change."""
    return tuple(h["removed"]), tuple(h["added"])


def pending(before: str, after: str, doc: str, most: int | None = MAX_CELLS) -> list[dict]:
    """The hunks of the document that are, line for line, hunks of the change from before to after: a semi-join by content."""
    made = {changed(h) for h in hunks(before, after, most)}
    return [h for h in hunks(before, doc, most) if changed(h) in made]


def less(before: str, after: str, chosen: list[dict]) -> str:
    """after with hunks of equal content taken back, the first for the first, each once."""
    left = [changed(h) for h in chosen]
    alike = []
    for h in hunks(before, after):
        if changed(h) in left:
            left.remove(changed(h))
            alike.append(h)
    return reverted(after, alike)


def without(before: str, after: str, h: dict) -> str:
    """after with the first hunk of equal content taken back."""
    return less(before, after, [h])


def over(rows: DataFrame, function, kind: str, name: str, *columns: str) -> DataFrame:
    """rows with `name`: the function of the columns, null texts as empty, in Arrow batches."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [function(*(x if x is not None else "" for x in r)) for r in zip(*(b[c] for c in columns), strict=True)]})

    return rows.mapInPandas(run, ", ".join([*fields, f"{name} {kind}"]))


def diff_lines(rows: DataFrame) -> DataFrame:
    """rows of (before, after) with lines."""
    return over(rows, lambda a, b: [{"op": o, "text": t} for o, t in diff(a, b)], LINES, "lines", "before", "after")


def hunk_ranges(rows: DataFrame) -> DataFrame:
    """rows of (before, after) with hunks."""
    return over(rows, hunks, HUNKS, "hunks", "before", "after")


def reviewable(rows: DataFrame) -> DataFrame:
    """rows of (before, after, doc, kind) with hunks that still stand in doc; none for renames and deletions."""
    return over(rows, lambda a, b, d, k: [] if k in ("rename", "delete") else pending(a, b, d), HUNKS, "hunks", "before", "after", "doc", "kind")


def revert_pending(rows: DataFrame) -> DataFrame:
    """rows of (before, after, doc) with text: doc with all pending hunks put back."""
    return over(rows, lambda a, b, d: reverted(d, pending(a, b, d)), "string", "text", "before", "after", "doc")


def tally(lines: Column) -> Column:
    """(added, removed) of a lines column."""
    count = lambda op: F.size(F.filter(lines, lambda s: s["op"] == op))
    return F.struct(count("+").alias("added"), count("-").alias("removed"))


def grouped_hunks(diffed: DataFrame, key: str, context: int = 2) -> DataFrame:
    """(key, span, lo, hi): ranges of lines around the edits of each row, `context` lines on both sides, merged where they touch."""
    rows = diffed.select(key, F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line")).filter("line.op <> ' '")
    spans = rows.select(key, F.greatest(F.col("at") - context, F.lit(0)).alias("lo"), F.least(F.col("at") + context + 1, F.col("n")).alias("hi"))
    by = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (before.isNull() | (F.col("lo") > before)).cast("int")).withColumn("span", F.sum("new").over(by))
    return spans.groupBy(key, "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def added_lines(hunked: DataFrame, key: str) -> DataFrame:
    """(key, line): the lines of the later text that a hunk added."""
    h = hunked.select(key, F.explode("hunks").alias("h")).filter("h.after_end > h.after_start")
    return h.select(key, F.explode(F.sequence(F.col("h.after_start"), F.col("h.after_end") - 1)).alias("line"))


def hunk_key(path: Column, h: Column) -> Column:
    return F.concat_ws("|", path, h["before_start"], h["before_end"], h["after_start"], h["after_end"])


def accept_hunk(rows: DataFrame) -> DataFrame:
    """rows of (before, hunk) with text: the baseline with the hunk taken into it."""
    return over_hunk(rows, accepted, "string", "text", "before")


def reject_edit(rows: DataFrame) -> DataFrame:
    """rows of (after, hunk) with edit: the edit of the text that puts the hunk back."""
    edit = lambda a, h: dict(zip(("lo", "hi", "insert"), rejection(a, h), strict=True))
    return over_hunk(rows, edit, "struct<lo:int,hi:int,insert:string>", "edit", "after")


def drop_hunk(rows: DataFrame) -> DataFrame:
    """rows of (before, after, hunk) with text: after without the hunk."""
    return over_hunk(rows, without, "string", "text", "before", "after")


def over_hunk(rows: DataFrame, function, kind: str, name: str, *columns: str) -> DataFrame:
    """rows with `name`: the function of the text columns and of the struct column hunk; null texts as empty."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [function(*(t if t is not None else "" for t in r[:-1]), r[-1]) for r in zip(*(b[c] for c in columns), b["hunk"], strict=True)]})

    return rows.mapInPandas(run, ", ".join([*fields, f"{name} {kind}"]))


def hunk_lines(hunks: Column) -> Column:
    """How many lines the hunks of a column remove and add together."""
    return F.aggregate(hunks, F.lit(0), lambda n, h: n + F.size(h["removed"]) + F.size(h["added"]))


def changes_panel(diffed: DataFrame, key: str, most: int = 400) -> DataFrame:
    """(key, letter, added, removed, total, shown) of rows with kind and lines: a kind's letter, the tally and the first `most` lines."""
    t = tally(F.col("lines"))
    letter = F.when(F.col("kind").isin("create", "modify", "delete", "rename"), F.upper(F.substring("kind", 1, 1))).otherwise("?")
    return diffed.select(key, letter.alias("letter"), t["added"].alias("added"), t["removed"].alias("removed"), F.size("lines").alias("total"), F.slice("lines", 1, most).alias("shown"))


REVIEWED = "path string, action string, before string, after string, doc string, kind string, open boolean"


def reviewed(action: str, before: str, after: str, doc: str, hunk: str | None) -> dict:
    """The baseline, the written version and the document after an action; open: whether the two versions still differ."""
    most = None if action == "accept" else MAX_CELLS
    chosen = [h for h in pending(before, after, doc, most) if not hunk or json.dumps(list(map(list, changed(h)))) == hunk]
    if action == "accept":
        before = spliced(before, [(h["before_start"], h["before_end"], list(h["added"])) for h in chosen])
    elif action == "reject":
        after, doc = less(before, after, chosen), reverted(doc, chosen)
    else:
        raise ValueError(f"neither accept nor reject: {action}")
    return {"before": before, "after": after, "doc": doc, "kind": "modify" if before else "create", "open": before != after}


def review(rows: DataFrame) -> DataFrame:
    """(path, action, before, after, doc, kind, open) of rows (path, action, before, after, doc, hunk) after their actions.

    accept takes what is pending into the baseline, line by line however large the texts, and the document stays; reject takes it out of the
    written version and puts it back in the document. hunk, JSON of [removed, added], limits the action to
    hunks of that content. A row is open while the baseline and the written version differ; the reader's
    own edits are in the document only and keep nothing open. Any other action raises.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["action", "before", "after", "doc", "hunk"]
        for b in batches:
            b = b.fillna("")
            out = pd.DataFrame([reviewed(*r) for r in b[names].itertuples(index=False, name=None)], columns=["before", "after", "doc", "kind", "open"])
            yield pd.concat([b[["path", "action"]].reset_index(drop=True), out], axis=1)

    return rows.select("path", "action", "before", "after", "doc", "hunk").mapInPandas(run, REVIEWED)


def undo(changes: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, failed paths) after changes (path, kind, before, after, from) are undone, each by its kind.

    A created note goes, a deleted one comes back with its text, a renamed one gets its old path, a modified
    one loses what is still pending. A note that is missing though it should be there is reported.
    """
    joined = changes.join(notes.select(F.col("path").alias("_p"), F.col("content").alias("doc")), F.col("path") == F.col("_p"), "left").drop("_p")
    failed = joined.filter((F.col("kind") != "delete") & F.col("doc").isNull()).select("path")
    texts = revert_pending(joined.filter((F.col("kind") == "modify") & F.col("doc").isNotNull()).select("path", "before", "after", "doc"))
    back = texts.select("path", F.col("path").alias("to"), F.col("text").alias("content"))
    back = back.unionByName(joined.filter(F.col("kind") == "delete").select("path", F.col("path").alias("to"), F.col("before").alias("content")))
    back = back.unionByName(joined.filter((F.col("kind") == "rename") & F.col("doc").isNotNull()).select("path", F.col("from").alias("to"), F.col("doc").alias("content")))
    rest = notes.select("path", "content").join(changes.select("path"), "path", "left_anti")
    return rest.unionByName(back.select(F.col("to").alias("path"), "content")), failed


def restored(changes: DataFrame, disk: DataFrame, editor: DataFrame) -> DataFrame:
    """(path, text): the present text of each changed path, what an open editor holds before what is on disk."""
    e, d = (t.select(F.col("path").alias("_p"), F.col("content").alias(c)) for t, c in ((editor, "_e"), (disk, "_d")))
    met = changes.select("path").join(e, F.col("path") == F.col("_p"), "left").drop("_p").join(d, F.col("path") == F.col("_p"), "left")
    return met.select("path", F.coalesce("_e", "_d").alias("text"))


#: Fixed value: what starts a quote or a table row, which a widget must not part.
RUN = r"^\s*(?:>|\|)"


def widget_line(text: Column, line: Column) -> Column:
    """The line before which a widget for a hunk at `line` stands: the start of the quote or table run around it, at most the end."""
    rows = F.split(text, "\n")
    at = F.least(line, F.size(rows))
    before = F.reverse(F.slice(rows, F.lit(1), at))
    gap = F.array_position(F.transform(before, lambda r: r.rlike(RUN).cast("string")), F.lit("false"))
    inside = F.get(rows, at).rlike(RUN)
    return F.when(F.coalesce(inside, F.lit(False)), at - F.when(gap > 0, gap - 1).otherwise(F.size(before))).otherwise(at).cast("int")


def decorations(hunked: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, line, at_end): for each hunk of `hunks` a block row at its widget's line, and a line row for each line of `text` that it added.

    A hunk behind the last line has its block at the end. A block that moved up to the start of a quote or
    table has no line rows, as the run is drawn as one.
    """
    h = hunked.select(key, F.col(text).alias("_text"), F.explode("hunks").alias("h"))
    size = F.size(F.split("_text", "\n"))
    placed = h.withColumns({"line": widget_line(F.col("_text"), F.col("h.after_start")), "at_end": F.col("h.after_start") >= size, "last": F.least(F.col("h.after_end"), size)})
    hoisted = ~F.col("at_end") & F.coalesce(F.get(F.split("_text", "\n"), F.col("h.after_start")).rlike(RUN), F.lit(False))
    blocks = placed.select(key, F.lit("block").alias("kind"), "line", "at_end")
    tinted = placed.filter(~hoisted & (F.col("last") > F.col("h.after_start"))).select(key, F.explode(F.sequence(F.col("h.after_start"), F.col("last") - 1)).alias("line"))
    return blocks.unionByName(tinted.select(key, F.lit("line").alias("kind"), "line", F.lit(False).alias("at_end")))
