"""Keyed folds over event rows, in batch and as Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURN = "turn string, text string, tools array<struct<id:string,label:string,status:string,error:string>>, answer string, error string, done boolean"


def new_turn() -> dict:
    return {"text": "", "tools": [], "answer": None, "error": None, "done": False}


def facts(frame: Column) -> Column:
    """What a frame tells of its turn, as (fact, key, value, error); null for one that tells nothing, JSON or not.

    fact is text (value: words), tool (key: id, none for a batch; value: label), status (key: id, value: the
    status, error) or last (key: the field that it fills).
    """
    v = F.try_parse_json(frame)
    at = lambda path: F.try_variant_get(v, f"$.{path}", "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    whole = lambda path: F.when(kind(path) == "STRING", at(path))
    spelled = lambda path: F.when(kind(path).rlike("^(STRING|BIGINT|BOOLEAN|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), at(path))
    fact = lambda name, key, value, error=None: F.struct(F.lit(name).alias("fact"), key.cast("string").alias("key"), value.alias("value"), (F.lit(None) if error is None else error).cast("string").alias("error"))
    word = lambda path: F.coalesce(spelled(path), F.lit("None"))
    event = F.when(at("type") == "chat_event", at("event.type"))
    none = F.lit(None)
    return (
        F.when(at("type") == "chat_done", fact("last", F.lit("answer"), F.coalesce(whole("answer"), F.lit(""))))
        .when(at("type") == "chat_error", fact("last", F.lit("error"), F.coalesce(whole("error"), F.lit("unknown error"))))
        .when((event == "delta") & (at("event.kind") == "text"), fact("text", none, F.coalesce(spelled("event.text"), F.lit(""))))
        .when(event == "tool_start", fact("tool", word("event.id"), word("event.name")))
        .when(event == "batch", fact("tool", none, F.concat(word("event.kind"), F.lit(" · "), word("event.label"))))
        .when(event == "tool_done", fact("status", word("event.id"), F.lit("done")))
        .when(event == "tool_error", fact("status", word("event.id"), F.lit("error"), F.coalesce(spelled("event.error"), F.lit(""))))
    )


def with_facts(frames: DataFrame) -> DataFrame:
    """frames (turn, seq, frame, ...) with the columns fact, key, value and error in place of the frame."""
    rest = [c for c in frames.columns if c != "frame"]
    return frames.withColumn("_f", facts(F.col("frame"))).select(*rest, "_f.fact", "_f.key", "_f.value", "_f.error")


def told(turn: dict, rows: pd.DataFrame) -> dict:
    """The turn after the facts: texts joined, tools in the order they began, each with its last status, the last end."""
    known = list(rows.sort_values("seq", kind="stable")[["fact", "key", "value", "error"]].itertuples(index=False, name=None))
    tools = list(turn["tools"])
    place: dict[str, int] = {}
    for k, t in enumerate(tools):
        place.setdefault(t["id"], k)
    for fact, key, value, error in known:
        if fact == "tool":
            key = f"batch:{len(tools)}" if key is None else key
            place.setdefault(key, len(tools))
            tools.append({"id": key, "label": value, "status": "run", "error": None})
        elif fact == "status" and key in place:  # a status before its tool tells nothing
            tools[place[key]] = tools[place[key]] | {"status": value} | ({} if error is None else {"error": error})
    ends = {key: value for fact, key, value, _ in known if fact == "last"}
    return turn | {"text": turn["text"] + "".join(value for fact, _, value, _ in known if fact == "text"), "tools": tools, "done": turn["done"] or bool(ends)} | ends


def chat_turns(frames: DataFrame) -> DataFrame:
    """One row per turn of frames (turn string, seq long, frame string), folded in order; a turn is one group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"turn": rows["turn"].iloc[0], **told(new_turn(), rows)}])

    return with_facts(frames).groupBy("turn").applyInPandas(fold, TURN)


def chat_turns_stream(frames: DataFrame, expire_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """The turns of a stream of frames after each batch; a turn's state goes when it is done, or silent for expire_ms.

    Silence is told by event time where the frames have a column ts: the watermark lags by `late`, frames
    behind it are dropped, and a turn ends once the watermark is expire_ms past its last frame. Without ts it
    is told by the clock; the query then keeps running batches while it waits, so it never comes to rest.
    """
    timed = "ts" in frames.columns

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            turn = json.loads(state.get[0])["turn"] | {"error": "timed out", "done": True}
            state.remove()
            yield pd.DataFrame([{"turn": key[0], **turn}])
            return
        held = json.loads(state.get[0]) if state.exists else {"turn": new_turn(), "last": 0}
        rows = pd.concat(list(batches))
        turn = told(held["turn"], rows)
        if turn["done"]:
            if state.exists:
                state.remove()
        else:
            last = max(held["last"], int(rows["ts"].max().timestamp() * 1000)) if timed else 0
            state.update((json.dumps({"turn": turn, "last": last}),))
            if expire_ms and timed:
                state.setTimeoutTimestamp(max(last + expire_ms, state.getCurrentWatermarkMs() + 1))
            elif expire_ms:
                state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame([{"turn": key[0], **turn}])

    rows = with_facts(frames.withWatermark("ts", late) if timed else frames)
    timeout = GroupStateTimeout.NoTimeout if not expire_ms else GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("turn").applyInPandasWithState(fold, TURN, "state string", "update", timeout)


def conversation_texts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, text): each conversation's texts in the order of its turns, folded into one."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    rows = conversations.groupBy("conv_id").agg(parts.alias("p"), F.count("*").alias("turns"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("p", lambda s: s["text"]), "").alias("text"))


def debounced(events: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """(user_id, start, n, last_event): bursts of events closer than the gap, with the last of each. Works on streams with a watermark."""
    burst = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event")).select("user_id", F.col("w.start").alias("start"), "n", "last_event")
