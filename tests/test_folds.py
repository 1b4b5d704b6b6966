"""Diff laws, change and chat folds, streams."""

import json
import random

import pytest

from vellum.operators import diffs
from vellum.plans import catalogue
from vellum.streaming import folds

PAIRS = [("", ""), ("", "a\nb"), ("a\nb", ""), ("a\nb\nc", "a\nx\nc"), ("a\nb\nc", "a\nc"), ("a\nc", "a\nb\nc"), ("a", "a\n"), ("a\n", "a"), ("x\na\nb", "a\nb\ny"), ("a\nb\nc\nd\ne", "a\nB\nc\nD\ne"), ("same\n\n", "same\n\n"), ("\n", "\n\n")]


def more():
    rnd = random.Random(3)
    text = lambda: "\n".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))
    return [(text(), text()) for _ in range(150)]


@pytest.mark.parametrize("before,after", PAIRS + more())
def test_laws(before, after):
    lines = diffs.diff(before, after)
    assert [t for o, t in lines if o != "+"] == diffs.lines_of(before) and [t for o, t in lines if o != "-"] == diffs.lines_of(after)
    base = before
    while found := diffs.hunks(base, after):
        base = diffs.accepted(base, found[0])
    assert diffs.lines_of(base) == diffs.lines_of(after)
    assert diffs.reverted(after, diffs.hunks(before, after)) == before
    doc = after
    while found := diffs.hunks(before, doc):
        lo, hi, text = diffs.rejection(doc, found[-1])
        doc = doc[:lo] + text + doc[hi:]
    assert doc == before
    left = after
    while found := diffs.hunks(before, left):
        left = diffs.without(before, left, found[0])
    assert left == before


def test_longest_common_lines_are_kept():
    a, b = "a\nb\nc\na\nb\nb\na", "c\nb\na\nb\na\nc"
    assert sum(o == " " for o, _ in diffs.diff(a, b)) == 4
    assert diffs.diff("x\ny", "y\nx")[0] == ("-", "x")


def test_large_changes_become_one_block():
    a, b = "\n".join(f"a{i}" for i in range(1500)), "\n".join(f"b{i}" if i % 2 else f"a{i}" for i in range(1501))
    assert len(diffs.hunks("h\n" + a, "h\n" + b)) >= 1
    ops = [o for o, _ in diffs.diff("\n".join(f"a{i}" for i in range(1500)) + "\nq", "z\n" + "\n".join(f"a{i}" for i in range(1500)))]
    assert ops == ["-"] * 1501 + ["+"] * 1501


def test_columns(spark):
    rows = spark.createDataFrame([(i, a, b, b, "modify") for i, (a, b) in enumerate(PAIRS)] + [(99, "a", "b", "b", "delete"), (100, None, None, None, "modify")], "id int, before string, after string, doc string, kind string")
    got = {r.id: r.text for r in diffs.revert_pending(rows).collect()}
    assert all(got[i] == a for i, (a, _) in enumerate(PAIRS)) and got[100] == ""
    assert {r.id: len(r.hunks) for r in diffs.reviewable(rows).collect()}[99] == 0
    spans = diffs.grouped_hunks(diffs.diff_lines(rows), "id").filter("id = 9").collect()
    assert [(r.lo, r.hi) for r in spans] == [(0, 7)]
    assert {r.line for r in diffs.added_lines(diffs.hunk_ranges(rows), "id").filter("id = 9").collect()} == {1, 3}


def test_pairs_of_texts_keep_every_line(spark, tmp_path):
    texts = {1: "one", 2: "\n".join(f"line {i}" for i in range(2500)), 3: "", 4: None}
    spark.createDataFrame([(i, "s", t) for i, t in texts.items()], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.after for r in catalogue.pairs_of_texts(spark, str(tmp_path)).collect()}
    assert got[2].split("\n") == ["one"] + [f"line {i}" for i in range(1, 2500)]
    assert {i: got[i] for i in (1, 3, 4)} == {1: "\n", 3: "line 0\n", 4: "\n"}


FRAMES = [
    {"type": "chat_event", "event": {"type": "delta", "kind": "text", "text": "he"}},
    {"type": "chat_event", "event": {"type": "delta", "kind": "reasoning", "text": "no"}},
    {"type": "chat_event", "event": {"type": "tool_start", "id": 1, "name": "grep"}},
    {"type": "chat_event", "event": {"type": "batch", "kind": "index", "label": "notes"}},
    {"type": "chat_event", "event": {"type": "delta", "kind": "text", "text": "y"}},
    {"type": "chat_event", "event": {"type": "tool_error", "id": 1, "error": "bad"}},
    {"type": "chat_done", "answer": "hey"},
]


def frames(spark, upto):
    return spark.createDataFrame([("t", i, json.dumps(f)) for i, f in enumerate(FRAMES[:upto])] + [("u", 0, "not json"), ("u", 1, '{"type": "chat_error"}')], "turn string, seq long, frame string")


def test_chat_fold(spark):
    got = {r.turn: r for r in folds.chat_turns(frames(spark, 7)).collect()}
    assert (got["t"].text, got["t"].answer, got["t"].done) == ("hey", "hey", True)
    assert [(t.id, t.label, t.status, t.error) for t in got["t"].tools] == [("1", "grep", "error", "bad"), ("batch:1", "index · notes", "run", None)]
    assert got["u"].error == "unknown error"


def test_chat_stream(spark, tmp_path):
    frames(spark, 4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("turn string, seq long, frame string").parquet(str(tmp_path / "in"))
    query = folds.chat_turns_stream(stream).writeStream.outputMode("update").format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    spark.createDataFrame([("t", i, json.dumps(FRAMES[i])) for i in range(4, 7)], "turn string, seq long, frame string").write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert {(r.text, r.done) for r in spark.table("turns").filter("turn = 't' and done").collect()} == {("hey", True)}
