"""Answer sessions as a stateful stream: reads of event streams, cut anywhere, become events and final states.

A read is (session_id, seq, ts, piece): piece number ``seq`` of what one client received.  ``events`` keeps for each
session the text of a frame that is not complete yet, and the pieces that came before an earlier one; it gives an event a
frame, whatever the cuts, the order within the stream and the micro-batches.  A session that has no end ``limit`` after its first read gets a
``cancelled`` event once the watermark has passed that time, and what comes later is ignored; a finished session's state is a single row.

Defined results: comments and frames without data are dropped; a frame that is not JSON, or has no type, has type ``unknown``; a repeated
``seq`` is ignored; a null piece is empty; reads without session or number are dropped; what follows the first ``done``, ``error``
or ``cancelled`` is ignored; a frame that is never completed gives nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import model

ENDS = ("done", "error", "cancelled")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "session_id string, place int, type string, event string"


def _data(frame: str) -> str:
    """The data lines of a frame, joined."""
    return "\n".join(x.removeprefix("data:").removeprefix(" ") for x in frame.split("\n") if x.startswith("data:"))


def _type(data: str) -> str:
    try:
        kind = json.loads(data).get("type")
    except (ValueError, AttributeError):
        return "unknown"
    return kind if isinstance(kind, str) else "unknown"


class _Sessions(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "next int, held string, place int, begun long, ended boolean, waiting boolean")
        self.early = handle.getListState("early", "seq int, piece string")

    def _state(self) -> tuple:
        return self.open.get() or (0, "", 0, -1, False, False)  # each call is a message to the JVM

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, held, place, begun, ended, waiting = self._state()
        if ended:
            return
        came = dict(self.early.get()) if waiting else {}
        first = None
        for part in rows:
            for seq, piece, ts in zip(part["seq"], part["piece"], part["ms"]):
                if seq >= at:
                    came.setdefault(int(seq), piece if isinstance(piece, str) else "")
                first = int(ts) if first is None else min(first, int(ts))
        if begun < 0 and first is not None:
            begun = first
            self.handle.registerTimer(begun + self.limit_ms)
        out = []
        while at in came and not ended:
            *whole, held = (held + came.pop(at)).split("\n\n")
            at += 1
            for data in filter(None, map(_data, whole)):
                kind = _type(data)
                out.append((key[0], place, kind, data))
                place, ended = place + 1, kind in ENDS
                if ended:
                    break
        if ended:
            came.clear()
            self.handle.deleteTimer(begun + self.limit_ms)
            held = ""
        if came:
            self.early.put([(k, v) for k, v in sorted(came.items())])
        elif waiting:
            self.early.clear()
        self.open.update((at, held, place, begun, ended, bool(came)))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "place", "type", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _, place, begun, ended, waiting = self._state()
        if not ended:
            if waiting:
                self.early.clear()
            self.open.update((at, "", place + 1, begun, True, False))
            event = json.dumps({"type": "cancelled", "elapsedMs": self.limit_ms})
            yield pd.DataFrame([(key[0], place, "cancelled", event)], columns=["session_id", "place", "type", "event"])

    def close(self) -> None:
        pass


def events(reads: DataFrame, limit_seconds: int = model.REQUEST_SECONDS, late: str = "10 seconds") -> DataFrame:
    """``reads``: a stream of session_id, seq, ts, piece -> session_id, place, type, event.  Needs the RocksDB state store (``ROCKSDB``)."""
    known = reads.filter(F.col("session_id").isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull())
    slim = known.select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("int").alias("seq"), "ts", "piece", F.unix_millis("ts").alias("ms"))
    return slim.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(_Sessions(limit_seconds * 1000), _EVENT, "Append", "EventTime")


def states(found: DataFrame) -> DataFrame:
    """What each client shows in the end: status, the text of its tokens, events."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("place", F.get_json_object("event", "$.text").alias("text"))))), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    status = F.max(F.when(F.col("type").isin(*ENDS), F.col("type")))
    return found.groupBy("session_id").agg(F.coalesce(status, F.lit("streaming")).alias("status"), text.alias("text"), F.count("*").cast("int").alias("events"))


def run(reads: DataFrame, folder: str, checkpoint: str, limit_seconds: int = model.REQUEST_SECONDS, late: str = "10 seconds") -> None:
    """Follow the stream ``reads`` to its present end; events are appended to the Parquet table ``folder``.  Session settings are restored."""
    conf, name = reads.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKSDB)
    try:
        events(reads, limit_seconds, late).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def cut(streams: DataFrame, size: int) -> DataFrame:
    """``streams``: session_id, ts, text -> reads of ``size`` characters each."""
    n = F.greatest(F.ceil(F.length("text") / size).cast("int"), F.lit(1))
    pieces = streams.select("session_id", "ts", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return pieces.select("session_id", "seq", "ts", F.substring(F.col("text"), F.col("seq") * size + 1, F.lit(size)).alias("piece"))
