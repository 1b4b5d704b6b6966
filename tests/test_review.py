"""Review, undo, restore and placement over rows."""

from pyspark.sql import functions as F

from vellum.operators import diffs
from vellum.sources import notes as vault


def test_undo_follows_the_kind(spark):
    notes = spark.createDataFrame([("new.md", "x"), ("mod.md", "a\nB"), ("to.md", "same"), ("other.md", "o")], "path string, content string")
    rows = [("new.md", "create", "", "x", None), ("mod.md", "modify", "a\nb", "a\nB", None), ("to.md", "rename", "same", "same", "from.md"), ("gone.md", "delete", "was", "", None), ("lost.md", "modify", "1", "2", None)]
    back, failed = diffs.undo(spark.createDataFrame(rows, "path string, kind string, before string, after string, `from` string"), notes)
    assert sorted(map(tuple, back.collect())) == [("from.md", "same"), ("gone.md", "was"), ("mod.md", "a\nb"), ("other.md", "o")]
    assert [r.path for r in failed.collect()] == ["lost.md"]


def test_single_hunks_and_the_editor_before_the_disk(spark):
    h = diffs.hunks("a\nb\nc", "a\nx\nc")[0]
    kind = "before string, after string, hunk struct<before_start:int,before_end:int,after_start:int,after_end:int,removed:array<string>,added:array<string>>"
    rows = spark.createDataFrame([("a\nb\nc", "a\nx\nc", tuple(h.values()))], kind)
    assert diffs.accept_hunk(rows).first().text == "a\nx\nc" and diffs.drop_hunk(rows).first().text == "a\nb\nc"
    e = diffs.reject_edit(rows).first().edit
    assert (e.lo, e.hi, e.insert) == (2, 3, "b")
    t = lambda *r: spark.createDataFrame(list(r), "path string, content string")
    got = {r.path: r.text for r in diffs.restored(t(("a", ""), ("b", ""), ("c", "")), t(("a", "disk"), ("b", "disk")), t(("a", "open"))).collect()}
    assert got == {"a": "open", "b": "disk", "c": None}


def test_a_widget_stands_before_its_quote_or_table(spark):
    text = "one\n> q1\n> q2\ntwo\n| t |"
    at = lambda n: spark.range(1).select(diffs.widget_line(F.lit(text), F.lit(n)).alias("x")).first().x
    assert [at(0), at(1), at(2), at(3), at(4), at(9)] == [0, 1, 1, 3, 4, 5]
    assert vault.folders_of(" a, ,b/c ,") == ["a", "b/c"]


def reviewed(spark, *rows):
    columns = "path string, action string, before string, after string, doc string, hunk string"
    return [(r.before, r.after, r.doc, r.kind, r.open) for r in diffs.review(spark.createDataFrame(list(rows), columns)).collect()]


def test_the_readers_own_edits_keep_nothing_open(spark):
    got = reviewed(spark, ("p", "accept", "a", "a\nb", "r\na\nb", None), ("p", "reject", "a", "a\nb", "r\na\nb", None))
    assert got == [("a\nb", "a\nb", "r\na\nb", "modify", False), ("a", "a", "r\na", "modify", False)]


def test_one_hunk_at_a_time_and_a_new_note(spark):
    before, after = "a\nb\nc\nd", "A\nb\nc\nD"
    first = '[["a"], ["A"]]'
    got = reviewed(spark, ("p", "accept", before, after, after + "\nmine", first), ("p", "reject", before, after, "x\n" + after, first), ("p", "reject", "", "new", "new", None))
    assert got[0] == ("A\nb\nc\nd", after, after + "\nmine", "modify", True)
    assert got[1] == (before, after, "x\n" + after, "modify", True)  # the reader's line grew the block, so it is not pending
    assert got[2] == ("", "", "", "create", False)


def test_equal_hunks_are_taken_back_once_each():
    before, after = "x\n1\nx\n2\nx", "y\n1\ny\n2\nx"
    found = diffs.hunks(before, after)
    assert diffs.less(before, after, found[:1]) == "x\n1\ny\n2\nx" and diffs.less(before, after, found) == before


def test_any_other_action_raises():
    import pytest

    with pytest.raises(ValueError):
        diffs.reviewed("settle", "", "", "", None)


def test_keys_lines_and_decorations_of_hunks(spark):
    rows = spark.createDataFrame([("k", "a\n> q\n> r\nb\nc", "A\n> q\n> R\nb")], "path string, before string, after string")
    hunked = diffs.hunk_ranges(rows)
    assert hunked.select(diffs.hunk_lines(F.col("hunks")).alias("n")).first().n == 5
    keys = hunked.select(F.explode("hunks").alias("h")).select(diffs.hunk_key(F.lit("k"), F.col("h")).alias("x")).collect()
    assert [r.x for r in keys] == ["k|0|1|0|1", "k|2|3|2|3", "k|4|5|4|4"]
    got = sorted((r["kind"], r["line"], r["at_end"]) for r in diffs.decorations(hunked, "path", "after").collect())
    assert got == [("block", 0, False), ("block", 1, False), ("block", 4, True), ("line", 0, False)]
    panel = diffs.changes_panel(diffs.diff_lines(rows.withColumn("kind", F.lit("rename"))), "path", 3).first()
    assert (panel.letter, panel.added, panel.removed, panel.total, len(panel.shown)) == ("R", 2, 3, 7, 3)


def test_a_text_of_any_size_is_accepted_line_by_line(spark):
    lines = [f"line {i % 700}" for i in range(2000)]
    before, after = "\n".join(lines), "\n".join(["first", *lines[1:]])
    doc = after + "\nmine"
    assert [diffs.changed(h) for h in diffs.hunks(before, doc, None)] == [(("line 0",), ("first",)), ((), ("mine",))]
    assert reviewed(spark, ("p", "accept", before, after, doc, None)) == [(after, after, doc, "modify", False)]


def test_ops_are_those_of_the_table_of_lengths():
    import numpy as np

    for seed in range(300):
        draw = np.random.default_rng(seed)
        p, q = (draw.integers(0, 1 + seed % 7, draw.integers(0, 25)) for _ in "pq")
        length = np.zeros((len(p) + 1, len(q) + 1), int)
        for i in range(len(p) - 1, -1, -1):
            for j in range(len(q) - 1, -1, -1):
                length[i, j] = length[i + 1, j + 1] + 1 if p[i] == q[j] else max(length[i + 1, j], length[i, j + 1])
        want, i, j = [], 0, 0
        while i < len(p) and j < len(q):
            op = " " if p[i] == q[j] else "-" if length[i + 1, j] >= length[i, j + 1] else "+"
            want.append(op)
            i, j = i + (op != "+"), j + (op != "-")
        assert "".join(diffs.walk(p, q)) == "".join(want) + "-" * (len(p) - i) + "+" * (len(q) - j)
