"""The maintained index, the change fold and frames: streams against batches."""

import json
import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from vellum.operators.index import stem_counts
from vellum.streaming import changes, folds, frames, index_log

WRITES = "session string, seq long, path string, kind string, before string, after string, `from` string"
NOTES = "path string, mtime long, content string, gone boolean"


def batch(spark, rows):
    return spark.createDataFrame(rows, NOTES)


def stems(spark, folder):
    return {(r["path"], r["stem"]) for r in index_log.current_counts(spark, folder).collect()}


def test_emptied_deleted_and_moved_notes_leave_no_stems(spark, tmp_path):
    at = str(tmp_path / "index")
    index_log.add_batch(batch(spark, [("a", 1, "walking houses", False), ("b", 1, "gamma", False), ("c", 1, "delta", False)]), at, 0)
    index_log.add_batch(batch(spark, [("a", 2, "", False), ("b", 2, None, True), ("d", 2, "delta", False), ("c", 2, None, True)]), at, 1)
    for _ in range(2):
        assert stems(spark, at) == {("d", "delta")}
        assert {r["path"] for r in index_log.current_notes(spark, at).collect()} == {"a", "d"}
        index_log.compact(spark, at)
    assert index_log.parts(spark, at) == [f"{at}/base=1"]
    # an older row that comes late changes nothing, a newer one does
    index_log.add_batch(batch(spark, [("b", 1, "gamma", False), ("a", 3, "alpha", False)]), at, 2)
    assert stems(spark, at) == {("d", "delta"), ("a", "alpha")}


def test_a_batch_that_runs_again_replaces_itself_and_half_a_version_does_not_count(spark, tmp_path):
    at = str(tmp_path / "index")
    for text in ("first words", "second words"):
        index_log.add_batch(batch(spark, [("a", 1, text, False)]), at, 0)
    stem_counts(batch(spark, [("b", 1, "lost", False)])).write.parquet(f"{at}/batch=1/counts")
    assert stems(spark, at) == {("a", "second"), ("a", "word")}


def test_random_batches_equal_a_fresh_count(spark, tmp_path):
    rnd, at, now = random.Random(2), str(tmp_path / "index"), {}
    for number in range(6):
        rows = []
        for p in rnd.sample("abcdefgh", 4):
            text = rnd.choice(["", " ".join(rnd.choices(["apple", "pear", "stone", "river"], k=3)), None])
            rows.append((p, number, text, text is None))
            now[p] = text
        index_log.add_batch(batch(spark, rows), at, number)
        if number % 2:
            index_log.compact(spark, at)
    fresh = stem_counts(batch(spark, [(p, 0, t, False) for p, t in now.items()]))
    assert sorted(map(tuple, index_log.current_counts(spark, at).collect())) == sorted(map(tuple, fresh.collect()))


def test_a_stream_is_compacted_and_starts_again(spark, tmp_path):
    schema = "path string, mtime long, content string"
    run = lambda: index_log.maintain_index(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "cp"), every=2).trigger(availableNow=True).start().awaitTermination()
    for k, text in enumerate(["alpha", "beta", "gamma", ""]):
        spark.createDataFrame([("a", k, text)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert stems(spark, str(tmp_path / "index")) == set() and len(index_log.parts(spark, str(tmp_path / "index"))) <= 3


def write(path, before, after, kind="modify", old=None):
    return {"path": path, "kind": kind, "before": before, "after": after, "from": old}


def test_rows_of_one_session():
    held = changes.Held()
    for i, c in enumerate((write("a", "one\ntwo\nx", "one\nTWO\nx"), write("a", "one\nTWO\nx\nmine", "ONE\nTWO\nx\nmine"), write("b", "", "x"), write("b", "x", ""), write("c", "", "new"), write("d", "", "", "rename", "c"))):
        changes.take(held, c, i)
    assert held.rows["a"]["before"] == "one\ntwo\nx\nmine" and "b" not in held.rows
    assert held.rows["d"] == {"kind": "create", "before": "", "after": "new", "from": "c"}
    changes.take(held, write("q", "", "", "rename", "p"), 7)
    assert held.rows["q"]["kind"] == "rename"
    for i in range(250):
        changes.take(held, write(f"f{i}", "", "x"), 10 + i)
    assert len(held.rows) == changes.MAX_CHANGED and "a" not in held.rows


def random_writes(seed, sessions=3, each=40, files=6):
    rnd, rows = random.Random(seed), []
    for s in range(sessions):
        disk = {}
        for seq in range(each):
            path = f"f{rnd.randrange(files)}"
            if disk and rnd.random() < 0.25:
                old = rnd.choice(sorted(disk))
                disk[path] = disk.pop(old)
                rows.append((f"s{s}", seq, path, "rename", "", "", old))
                continue
            before = disk.get(path, "")
            if before and rnd.random() < 0.4:  # the reader types
                before += "\nmine" + str(seq)
            lines = before.split("\n") if before else []
            if lines and rnd.random() < 0.3:
                lines.pop(rnd.randrange(len(lines)))
            else:
                lines.insert(rnd.randint(0, len(lines)), f"line {seq}")
            after = "\n".join(lines)
            disk[path] = after
            rows.append((f"s{s}", seq, path, "modify", before, after, None))
    return rows


def in_order(rows):
    out = set()
    for s in {r[0] for r in rows}:
        held = changes.Held()
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            changes.take(held, changes.plain(dict(zip(("session", "seq", "path", "kind", "before", "after", "from"), r, strict=True))), r[1])
        order = sorted(held.rows, key=lambda p: held.slots[p])
        out |= {(s, order.index(p), p, r["kind"], r["before"], r["after"], r["from"]) for p, r in held.rows.items()}
    return out


@pytest.mark.parametrize("most", [200, 4])
def test_parts_and_whole_sessions_equal_the_order_of_writes(spark, monkeypatch, most):
    monkeypatch.setattr(changes, "MAX_CHANGED", most)
    rows = random_writes(1)
    got = changes.change_fold(spark.createDataFrame(rows, WRITES).repartition(5)).collect()
    if most == 200:  # workers have the constant of the module
        assert {tuple(r) for r in got} == in_order(rows)
    parts = changes.parted(spark.createDataFrame(rows, WRITES)).select("session", "part").distinct().count()
    assert parts >= (3 if most == 200 else 1)


def test_a_session_of_many_files_keeps_the_newest(spark):
    rows = [("s", i, f"f{i:03}", "modify", "", "x", None) for i in range(230)] + [("s", 300, "f000", "modify", "x", "y", None)]
    got = {r["path"]: r for r in changes.change_fold(spark.createDataFrame(rows, WRITES)).collect()}
    assert len(got) == 200 and "f030" not in got and got["f031"]["position"] == 0
    assert got["f000"]["before"] == "x" and got["f000"]["position"] == 199  # its row had gone, so it starts anew


def test_the_change_stream_equals_the_batch(spark, tmp_path):
    rows = random_writes(5, sessions=2, each=30)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir(exist_ok=True)
    stream = spark.readStream.schema(WRITES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = None
    try:
        for lo in range(0, 30, 10):
            spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 10], WRITES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if query is None:
                query = changes.change_fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "cp")).start()
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for r in spark.table("changed").collect():
        key = (r["session"], r["path"])
        if key not in last or last[key]["seq"] <= r["seq"]:
            last[key] = r
    got = {(s, p, r["kind"], r["before"], r["after"], r["from"]) for (s, p), r in last.items() if r["kind"] is not None}
    assert got == {(s, p, *rest) for s, _, p, *rest in in_order(rows)}


CONNECTIONS = [
    ("a", 0, '{"type":"rpc"}'), ("a", 1, "not json"), ("a", 2, '{"type":"welcome"}'), ("a", 3, '{"type":"rpc","id":1}'), ("a", 4, '{"type":"chat_done"}'), ("a", 5, '{"type":"ping"}'), ("a", 6, '{"type":"bye"}'), ("a", 7, '{"type":"rpc","id":2}'),
    ("b", 0, '{"type":"bye"}'), ("b", 1, '{"type":"welcome"}'), ("b", 2, '{"type":"rpc"}'), ("c", 0, '{"type":"chat_event"}'), ("d", 0, None),
]
PASSED = {("a", 3, "rpc"), ("a", 4, "chat"), ("a", 7, "rpc")}


def test_frames_pass_after_a_welcome_only(spark, tmp_path):
    schema = "connection string, seq long, frame string"
    rows = spark.createDataFrame(CONNECTIONS, schema)
    assert {(r["connection"], r["seq"], r["route"]) for r in frames.routed(rows).collect()} == PASSED
    (tmp_path / "in").mkdir(exist_ok=True)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows.filter("seq < 3").write.mode("append").parquet(str(tmp_path / "in"))
    query = frames.routed_stream(stream).writeStream.outputMode("append").format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    rows.filter("seq >= 3").write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert {(r["connection"], r["seq"], r["route"]) for r in spark.table("routed").collect()} == PASSED


def test_silent_turns_end_by_event_time_and_late_frames_are_dropped(spark, tmp_path):
    schema = "turn string, seq long, frame string, ts timestamp"
    start = datetime(2026, 1, 1, tzinfo=UTC)
    said = lambda turn, seq, text, sec: (turn, seq, json.dumps({"type": "chat_event", "event": {"type": "delta", "kind": "text", "text": text}}), start + timedelta(seconds=sec))
    steps = [[said("silent", 0, "one", 0), said("busy", 0, "a", 0)], [said("busy", 1, "b", 50)], [said("busy", 2, "c", 100), said("silent", 1, "late", 1)], [said("busy", 3, "d", 101)]]
    (tmp_path / "in").mkdir(exist_ok=True)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = None
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if query is None:
            query = folds.chat_turns_stream(stream, expire_ms=30_000, late="5 seconds").writeStream.outputMode("update").format("memory").queryName("silent_turns").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    deadline = time.time() + 60
    done = []
    while time.time() < deadline and not done:
        done = spark.table("silent_turns").filter("done").collect()
    query.stop()
    assert [(r["turn"], r["text"], r["error"]) for r in done] == [("silent", "one", "timed out")]
    texts = [r["text"] for r in spark.table("silent_turns").filter("turn = 'busy'").collect()]
    assert texts[-1] == "abcd" and all("late" not in r["text"] for r in spark.table("silent_turns").collect())


def test_bursts_over_a_stream_drop_late_events(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    start = datetime(2026, 1, 1, tzinfo=UTC)
    at = lambda user, event, sec: (user, event, start + timedelta(seconds=sec))
    (tmp_path / "in").mkdir(exist_ok=True)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = None
    for rows in ([at(1, 1, 0), at(1, 2, 0.2), at(1, 3, 10)], [at(2, 9, 100)], [at(1, 4, 10.1), at(2, 10, 200)], [at(2, 11, 300)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if query is None:
            query = folds.debounced(stream.withWatermark("ts", "5 seconds")).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    query.stop()
    got = {(r["user_id"], r["n"], r["last_event"]) for r in spark.table("bursts").collect()}
    assert {(1, 2, 2), (1, 1, 3), (2, 1, 9)} <= got and all(r[2] != 4 for r in got)
