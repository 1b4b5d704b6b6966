"""Markdown as rows: spans of a body with their offsets, and front matter as typed values.

The scans are small per-row helpers, linear in the text: lines once for front matter, fences and headings,
then one pass of a single alternation over what these leave. They run in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.storage import small_batches

SPANS = "array<struct<kind:string,lo:int,hi:int,line:int,level:int,form:string,target:string,target_lo:int,target_hi:int,sub:string,shown:string>>"
HEADING = re.compile(r"(#{1,6})[ \t]+(\S.*?)[ \t]*(?:[ \t]#+[ \t]*)?$")
FENCE = re.compile(r"(`{3,}|~{3,})")
#: In this order: code, math, links in double brackets, links with an address. No part may hold its own opening sign.
INLINE = re.compile(
    r"(?P<code>`[^`\n]+`)|(?P<math>\$\$[\s\S]*?\$\$|\$[^$\n]+\$)"
    r"|(?P<wiki>!?\[\[(?P<target>[^\[\]|#\n]*)(?P<sub>#[^\[\]|\n]*)?(?:\|(?P<shown>[^\[\]\n]*))?\]\])"
    r"|(?P<address>!?\[(?P<text>[^\[\]\n]*)\]\((?P<to><[^<>\n]*>|[^()<>\s#]*)(?P<part>#[^()\s]*)?(?:[ \t]+\"[^\"\n]*\")?\))"
)
#: What a link is not put into.
CLOSED = ("frontmatter", "code", "math", "heading", "link", "embed")


def spans_of(text: str) -> list[dict]:
    """The spans of a body in the order of their starts: frontmatter, code, math, heading, link and embed, end exclusive, lines from 1.

    A link tells its form, wiki or address, the target without what follows a #, that part, and the text
    shown. Inside front matter and code nothing else is found; a heading may hold links.
    """
    found, at, number = [], 0, 1
    open_lines: list[tuple[int, int, int]] = []  # (start, end, number) of lines that may hold inline spans
    fence, begun = "", (0, 0)
    rows = text.split("\n")
    front = front_lines(rows)
    span = lambda kind, lo, hi, line, **more: found.append({"kind": kind, "lo": lo, "hi": hi, "line": line, "level": None, "form": None, "target": None, "target_lo": None, "target_hi": None, "sub": None, "shown": None} | more)
    for k, row in enumerate(rows):
        end, number = at + len(row), k + 1
        if k < front:
            if k == front - 1:
                span("frontmatter", 0, end, 1)
        elif fence:
            bare = row.strip()
            if bare.startswith(fence) and not bare.strip(fence[0]):
                span("code", begun[0], end, begun[1])
                fence = ""
        elif m := FENCE.match(row.lstrip(" ")):
            fence, begun = m[1], (at, number)
        else:
            if m := HEADING.match(row.rstrip("\r")):
                span("heading", at, at + len(row.rstrip("\r")), number, level=len(m[1]), shown=m[2])
            open_lines.append((at, end, number))
        at = end + 1
    if fence:
        span("code", begun[0], len(text), begun[1])
    for lo, hi, lines in joined(open_lines):
        for m in INLINE.finditer(text, lo, hi):
            line = lines + text.count("\n", lo, m.start())
            lines, lo = line, m.start()
            if m["wiki"] or m["address"]:
                form, group, part, text_of = ("address", "to", "part", "text") if m["address"] else ("wiki", "target", "sub", "shown")
                to = m[group].strip("<> \t")
                begin = m.start(group) + m[group].index(to)
                kind = "embed" if m[0].startswith("!") else "link"
                span(kind, m.start(), m.end(), line, form=form, target=to, target_lo=begin, target_hi=begin + len(to), sub=m[part], shown=m[text_of])
            else:
                span("code" if m["code"] else "math", m.start(), m.end(), line)
    return sorted(found, key=lambda s: (s["lo"], -s["hi"]))


def joined(lines: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Runs of lines that follow each other, as (start, end, number of the first)."""
    run = None
    for lo, hi, number in lines:
        if run and lo == run[1] + 1:
            run = (run[0], hi, run[2])
        else:
            if run:
                yield run
            run = (lo, hi, number)
    if run:
        yield run


def front_lines(rows: list[str]) -> int:
    """How many lines front matter takes, its two rules included; 0 where there is none."""
    if rows[0].rstrip("\r") != "---":
        return 0
    return next((k + 1 for k in range(1, len(rows)) if rows[k].rstrip("\r \t") == "---"), 0)


def edited(text: str, edits: list) -> str:
    """The text with ranges (lo, hi, new) replaced; the ranges are apart."""
    out, at = [], 0
    for lo, hi, new in sorted((e["lo"], e["hi"], e["new"]) for e in edits):
        out += [text[at:lo], new]
        at = hi
    return "".join([*out, text[at:]])


def each(rows: DataFrame, function, kind: str, name: str, *columns: str) -> DataFrame:
    """rows with `name`: the function of the columns, in Arrow batches."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != name]
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [function(*r) for r in zip(*(b[c] for c in columns), strict=True)]})

    return rows.mapInPandas(run, ", ".join([*fields, f"{name} {kind}"]))


def spans(notes: DataFrame) -> DataFrame:
    """(path, kind, lo, hi, line, level, form, target, target_lo, target_hi, sub, shown) of every span of every note."""
    return each(notes.select("path", "content"), lambda t: spans_of(t or ""), SPANS, "spans", "content").select("path", F.inline("spans"))


# Front matter. Values are those of JSON.

PLAIN = re.compile(r"[^\s\[\]{}#&*!|>'\"%@`,:?-][^#:\r\n]*")
WORDS = {"true": True, "false": False, "null": None, "~": None, "": None}
KEY = re.compile(r"([^\s#:\[\]{}'\"-][^:]*?)[ \t]*:(?:[ \t]+(.*)|[ \t]*)$")


def scalar(raw: str):
    """The value of a scalar, a quoted string, or a list or object in brackets; anything else is a string."""
    raw = raw.strip()
    if raw.lower() in WORDS:
        return WORDS[raw.lower()]
    if raw[0] == "'" and raw[-1] == "'" and len(raw) > 1:
        return raw[1:-1].replace("''", "'")
    if re.fullmatch(r"[-+]?(0|[1-9]\d*)", raw):
        return int(raw)
    if re.fullmatch(r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?", raw) and not re.match(r"[-+]?0\d", raw):
        return float(raw)
    if raw[0] in '"[{':
        try:
            return json.loads(raw)
        except ValueError:
            pass
    if raw[0] == "[" and raw[-1] == "]":
        return [scalar(part) for part in re.findall(r"'(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"|[^,]+", raw[1:-1]) if part.strip()]
    return re.sub(r"[ \t]+#.*$", "", raw)


def entries(rows: list[str]) -> dict[str, tuple[int, int]]:
    """The line range of each key at the margin; the last of equal keys counts."""
    starts = [(k, m[1]) for k, row in enumerate(rows) if (m := KEY.match(row.rstrip("\r")))]
    return {key: (k, starts[i + 1][0] if i + 1 < len(starts) else len(rows)) for i, (k, key) in enumerate(starts)}


def value_of(rows: list[str]):
    """The value of one key's lines: what stands behind it, or the list or the object below it."""
    first = KEY.match(rows[0].rstrip("\r"))[2]
    below = [r.rstrip("\r") for r in rows[1:] if r.strip() and not r.lstrip().startswith("#")]
    if (first or "").strip() and not first.lstrip().startswith("#"):
        return "\n".join(r.strip() for r in below) if first.strip() in ("|", "|-", ">", ">-") else scalar(first)
    if below and all(r.lstrip().startswith("- ") or r.strip() == "-" for r in below):
        return [scalar(r.lstrip()[1:]) for r in below]
    if below:
        indent = min(len(r) - len(r.lstrip()) for r in below)
        inner = [r[indent:] for r in below]
        return {key: value_of(inner[lo:hi]) for key, (lo, hi) in entries(inner).items()}
    return None


def front_matter(text: str) -> str:
    """The front matter of a body as a JSON object, empty where there is none."""
    rows = (text or "").split("\n")
    inside = rows[1 : max(1, front_lines(rows) - 1)]
    return json.dumps({key: value_of(inside[lo:hi]) for key, (lo, hi) in entries(inside).items()})


def said(value) -> str:
    """A value as front matter says it, so that it reads back with its type."""
    if isinstance(value, str):
        return value if PLAIN.fullmatch(value) and scalar(value) == value and value == value.strip() else json.dumps(value, ensure_ascii=False)
    return json.dumps(value, ensure_ascii=False)


def with_property(text: str, name: str, value: str) -> str:
    """The body with one property set to a JSON value; its other lines stay as they are, and front matter is added where there is none."""
    new = json.loads(value)
    key = name if KEY.match(f"{name}:") else json.dumps(name)
    lines = [f"{key}:", *(f"  - {said(v)}" for v in new)] if isinstance(new, list) and new and not any(isinstance(v, list | dict) for v in new) else [f"{key}: {said(new)}"]
    rows = (text or "").split("\n")
    front = front_lines(rows)
    if not front:
        return "\n".join(["---", *lines, "---", *rows])
    inside = rows[1 : front - 1]
    lo, hi = entries(inside).get(name, (len(inside), len(inside)))
    return "\n".join([rows[0], *inside[:lo], *lines, *inside[hi:], *rows[front - 1 :]])
