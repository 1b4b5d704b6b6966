"""Frames of connections: what a connection's handshake lets through, and where each frame goes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROUTED = "connection string, seq long, route string, frame string"


def kind_of(frame: Column) -> Column:
    """The type of a JSON object; null for anything else."""
    return F.try_variant_get(F.try_parse_json(frame), "$.type", "string")


def route_of(kind: Column) -> Column:
    """Requests go to rpc, all chat frames to chat; other frames after the handshake go nowhere."""
    return F.when(kind == "rpc", "rpc").when(kind.startswith("chat_"), "chat")


def routed(frames: DataFrame) -> DataFrame:
    """(connection, seq, route, frame) of frames (connection, seq, frame): what comes after a connection's welcome, by its type.

    The first welcome or bye of a connection settles it: nothing passes before a welcome, nothing at all
    after a bye that came first. Text that is no JSON object is not a frame. seq numbers the frames of a
    connection.
    """
    known = frames.withColumn("kind", kind_of(F.col("frame")))
    hands = known.filter(F.col("kind").isin("welcome", "bye")).groupBy("connection").agg(F.min(F.struct("seq", "kind")).alias("first"))
    opened = hands.filter("first.kind = 'welcome'").select("connection", F.col("first.seq").alias("opened"))
    met = known.join(opened, "connection").filter("seq > opened").withColumn("route", route_of(F.col("kind")))
    return met.filter("route is not null").select("connection", "seq", "route", "frame")


def routed_stream(frames: DataFrame) -> DataFrame:
    """routed() over a stream; the state of a connection is whether it is open or refused. Frames come in order from batch to batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        if not now:
            hands = rows.index[rows["kind"].isin(["welcome", "bye"])]
            if not len(hands):
                return
            first = rows.loc[[hands[0]]].iloc[0]
            now = "open" if first["kind"] == "welcome" else "refused"
            rows = rows[rows["seq"] > first["seq"]]
            state.update((now,))
        if now == "open":
            yield rows.loc[rows["route"].notna(), ["connection", "seq", "route", "frame"]]

    known = frames.withColumn("kind", kind_of(F.col("frame"))).withColumn("route", route_of(F.col("kind")))
    return known.groupBy("connection").applyInPandasWithState(fold, ROUTED, "now string", "append", GroupStateTimeout.NoTimeout)
