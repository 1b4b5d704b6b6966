"""Writes of many sessions as one row for each changed file, in batch and over a stream.

A row stands between two texts: a start, which holds all that is not this session's doing, and the last
text written. A later write moves the start to the text it met, less what the row had left to review in
it. A rename takes the row along. A row whose two texts are empty is none. A session shows MAX_CHANGED rows
at most, and an older row goes for good when a new one comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vellum.operators.diffs import pending, reverted
from vellum.operators.graph import connected
from vellum.operators.ranks import rank_within
from vellum.storage import kept

#: Fixed value: changed files that are kept, the oldest going first.
MAX_CHANGED = 200
TEXTS = ["kind", "before", "after", "from"]


class Held:
    """The rows of a session in the order in which their paths came in, over a dictionary; a stream keeps them in its state."""

    def __init__(self, whole: bool = True):
        self.rows: dict[str, dict] = {}
        self.slots: dict[str, int] = {}
        self.whole = whole

    def get(self, path: str | None) -> dict | None:
        return self.rows.get(path)

    def put(self, path: str, row: dict, slot: int) -> None:
        self.slots.setdefault(path, slot)
        self.rows[path] = row

    def drop(self, path: str | None) -> None:
        self.rows.pop(path, None)
        self.slots.pop(path, None)

    def oldest(self) -> str | None:
        """The path to go, if there are too many."""
        return min(self.slots, key=lambda p: (self.slots[p], p)) if self.whole and len(self.slots) > MAX_CHANGED else None


def start_of(known: dict | None, met: str) -> str:
    """The text a row starts from when a write meets `met`."""
    return reverted(met, pending(known["before"], known["after"], met)) if known else met


def named(start: str, end: str) -> str | None:
    """What a row between two texts is called; none for two empty ones."""
    return {(True, True): None, (True, False): "create", (False, True): "delete"}.get((not start, not end), "modify")


def take(held, change: dict, slot: int) -> list[str]:
    """One write into the rows held; the paths that it touched."""
    path, source = change["path"], change["from"] if change["kind"] == "rename" else change["path"]
    known = held.get(source)
    if change["kind"] == "rename":
        held.drop(source)
        row = {**(known or change), "from": source}
    else:
        start = start_of(known, change["before"])
        row = {"kind": named(start, change["after"]), "before": start, "after": change["after"], "from": known and known["from"]}
    touched = [source, path]
    if row["kind"] is None:
        held.drop(path)
    else:
        held.put(path, {k: row[k] for k in TEXTS}, slot)
    while (old := held.oldest()) is not None:
        held.drop(old)
        touched.append(old)
    return [p for p in touched if p is not None]


def plain(r: dict) -> dict:
    """A write with null texts as empty ones."""
    word = lambda v: v if isinstance(v, str) else ""
    return {"path": word(r["path"]), "kind": word(r["kind"]), "before": word(r["before"]), "after": word(r["after"]), "from": r["from"] if isinstance(r["from"], str) else None}


def parted(changes: DataFrame) -> DataFrame:
    """changes with `part`: what can be folded apart.

    Files meet by renames only, so the paths that renames link are one part. Where a session touches more
    paths than are kept, which ones go depends on all of them, and the session is one part.
    """
    paths = changes.select("session", F.explode(F.array_distinct(F.array("path", F.coalesce("from", "path")))).alias("p"))
    many = kept(paths.groupBy("session").agg(F.countDistinct("p").alias("paths")).filter(F.col("paths") > MAX_CHANGED).select(F.col("session").alias("_s"), F.lit(True).alias("_whole")), "large-sessions")
    rows = changes.join(many, changes["session"].eqNullSafe(many["_s"]), "left").drop("_s")
    renames = changes.filter("kind = 'rename' and `from` is not null")
    if renames.limit(1).count():
        end = lambda c: F.struct("session", F.col(c).alias("path"))
        linked = connected(renames.select(end("from").alias("a"), end("path").alias("b")))
        linked = linked.select(F.col("path.session").alias("_s"), F.col("path.path").alias("_p"), F.col("component.path").alias("_part"))
        rows = rows.join(linked, rows["session"].eqNullSafe(linked["_s"]) & (rows["path"] == linked["_p"]), "left").drop("_s", "_p")
    else:
        rows = rows.withColumn("_part", F.lit(None).cast("string"))
    return rows.withColumn("part", F.when(F.col("_whole"), F.lit(None)).otherwise(F.coalesce("_part", "path"))).withColumn("whole", F.coalesce("_whole", F.lit(False))).drop("_whole", "_part")


def change_fold(changes: DataFrame) -> DataFrame:
    """(session, position, path, kind, before, after, from) of writes (session, seq, path, kind, before, after, from).

    Parts are read as sorted streams, so a task holds the rows of one part and no session's writes.
    Positions count the rows of a session from 0, in the order in which their paths came in.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, Held()
        rows = lambda: pd.DataFrame([{"session": at[0], "slot": held.slots[p], "path": p, **r} for p, r in held.rows.items()], columns=["session", "slot", "path", *TEXTS])
        for b in batches:
            for r in b.to_dict("records"):
                key = (r["session"], r["part"])
                if key != at:
                    if at is not None:
                        yield rows()
                    at, held = key, Held(r["whole"])
                take(held, plain(r), r["seq"])
        if at is not None:
            yield rows()

    order = parted(changes).repartition("session", "part").sortWithinPartitions("session", "part", "seq")
    found = order.select("session", "part", "whole", "seq", "path", *[f"`{c}`" for c in TEXTS]).mapInPandas(fold, "session string, slot long, path string, kind string, before string, after string, `from` string")
    found = kept(found, "folded")
    places = rank_within(found.select("session", "slot", "path"), "position", ["session"], [F.col("slot"), F.col("path")])
    places = places.select(F.col("session").alias("_s"), F.col("path").alias("_p"), (F.col("position") - 1).cast("long").alias("position"))
    same = found["session"].eqNullSafe(places["_s"]) & (found["path"] == places["_p"])
    return found.join(places, same).select("session", "position", "path", "kind", "before", "after", "from")


class ChangedFiles(StatefulProcessor):
    """The rows of a session as map state, a value for each path: a write reads and writes the rows that it touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "path string", "slot long, kind string, before string, after string, origin string")
        self.slots = handle.getMapState("slots", "slot long", "path string")
        self.counted = handle.getValueState("counted", "next long, size long")

    # what take() asks of the rows held
    def get(self, path: str | None) -> dict | None:
        if path is None or not self.rows.containsKey((path,)):
            return None
        slot, kind, before, after, origin = self.rows.getValue((path,))
        return {"slot": slot, "kind": kind, "before": before, "after": after, "from": origin}

    def put(self, path: str, row: dict, slot: int) -> None:
        known = self.get(path)
        if known is None:
            self.slots.updateValue((self.next,), (path,))
            slot, self.next, self.size = self.next, self.next + 1, self.size + 1
        else:
            slot = known["slot"]
        self.rows.updateValue((path,), (slot, row["kind"], row["before"], row["after"], row["from"]))

    def drop(self, path: str | None) -> None:
        if (known := self.get(path)) is not None:
            self.rows.removeKey((path,))
            self.slots.removeKey((known["slot"],))
            self.size -= 1

    def oldest(self) -> str | None:
        if self.size <= MAX_CHANGED:
            return None
        return min(((slot, path) for (slot,), (path,) in self.slots.iterator()))[1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.next, self.size = self.counted.get() if self.counted.exists() else (0, 0)
        touched: dict[str, int] = {}
        for r in sorted((r.asDict() for r in rows), key=lambda r: r["seq"]):
            touched |= dict.fromkeys(take(self, plain(r), r["seq"]), r["seq"])
        self.counted.update((self.next, self.size))
        for path, seq in touched.items():
            row = self.get(path)
            yield Row(session=key[0], path=path, seq=seq, slot=row and row["slot"], **{k: row and row[k] for k in ("kind", "before", "after")}, origin=row and row["from"])

    def close(self) -> None:
        pass


def change_fold_stream(changes: DataFrame) -> DataFrame:
    """(session, path, seq, slot, kind, before, after, from) of each path that a batch touched: its row after the batch, or nulls where it has none.

    Only touched rows are written to the state and given out; seq is the last write that touched the path.
    Needs a state store with column families (spark.sql.streaming.stateStore.providerClass: RocksDB's). The
    writes of a session come in order from batch to batch; inside a batch they are sorted by seq.
    """
    out = "session string, path string, seq long, slot long, kind string, before string, after string, origin string"
    return changes.groupBy("session").transformWithState(ChangedFiles(), out, "update", "none").withColumnRenamed("origin", "from")
