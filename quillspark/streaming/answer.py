"""A question answered as a stream of events: trace, tokens, citations, done.

The search runs in Spark; the few retrieved rows are on the driver, and the answer's text comes from
a generator seam.  Without a model, :class:`Extractive` quotes the first lines of the context.
"""

from __future__ import annotations

import json
import queue
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import model
from ..operators import citations as cite
from ..operators import context, search
from ..functions.stem import stem
from ..operators.chunk_generic import tokens_of

#: Fixed value: what the model is told.
SYSTEM_PROMPT = f"""\
You are a code documentation assistant. Answer only using the retrieved context blocks
attached to the conversation — never from general knowledge or prior training.

Cite every claim with a reference in the exact format {model.CITATION_FORMAT}, using the file
path and line range from the cited context block's header.

If the retrieved context does not answer the question, say so plainly and end the reply
with the exact sentence: "{model.REFUSAL}". Never invent a file path, line range, or
fact that is not present in the retrieved context."""


class Cancelled(Exception):
    """The client went away or the time is up."""


@dataclass
class Deadline:
    """Cancellation: by the client, or when the time is up."""

    seconds: float = model.REQUEST_SECONDS
    clock: Callable[[], float] = time.monotonic
    closed: bool = False
    tag: str = field(default_factory=lambda: f"answer-{uuid.uuid4().hex}")  # of the request's Spark jobs
    begun: float = field(init=False)

    def __post_init__(self) -> None:
        self.begun = self.clock()

    def left(self) -> float:
        return 0.0 if self.closed else max(0.0, self.begun + self.seconds - self.clock())

    def check(self) -> None:
        if not self.left():
            raise Cancelled


class Extractive:
    """Deterministic stand-in for a language model: cites the first blocks of the context."""

    def __call__(self, system: str, contents: Sequence[dict]) -> Iterator[tuple[str, str | None]]:
        text = contents[-1]["text"] if contents else ""
        heads = re.findall(r"^--- (\S+:\d+-\d+)", text, re.M)[:3]
        for head in heads:
            yield f"See {head}. ", None
        yield ("" if heads else model.REFUSAL), "STOP"


def last_question(messages: Sequence[dict]) -> str | None:
    return next((m["content"] for m in reversed(messages) if m["role"] == "user"), None)


def build_contents(messages: Sequence[dict], context_text: str) -> list[dict]:
    kept = list(messages)[-model.MAX_HISTORY_TURNS :]
    asked = max((k for k, m in enumerate(kept) if m["role"] == "user"), default=-1)
    return [{"role": "model" if m["role"] == "assistant" else "user", "text": f"{model.CONTEXT_MARKER}\n{context_text}\n\n{m['content']}" if k == asked else m["content"]} for k, m in enumerate(kept)]


def answer(chunks: DataFrame, messages: Sequence[dict], embed: Callable[[Sequence[str]], list[list[float]]], generate: Callable = Extractive(), options: model.SearchOptions = model.SearchOptions(), deadline: Deadline | None = None, stems: Callable[[str], str] | None = stem, lexical_index: str | None = None) -> Iterator[dict]:
    """Events of one request, each a dict with ``type``.

    ``stems``: as the table was indexed (stored tables hold stems).  ``lexical_index``: folder of the table's postings, which
    are read instead of all chunks.
    """
    deadline, begun, said = deadline or Deadline(), time.monotonic(), ""
    spark = chunks.sparkSession

    def since(t: float) -> int:
        return round((time.monotonic() - t) * 1000)

    question = last_question(messages)
    if question is None:
        yield {"type": "error", "message": "no user message"}
        return
    try:
        spark.sparkContext.addJobTag(deadline.tag)  # so that the jobs can be ended from outside
        deadline.check()
        vector = embed([question])[0]
        deadline.check()
        found = search.hybrid_search(chunks, vector, question, options, stems, lexical_index)
        ranked = [r.asDict() | {"pos": k} for k, r in enumerate(found.collect())]  # at most top_k rows
        trace = []
        if ranked:
            rows = spark.createDataFrame(ranked, StructType([*found.schema.fields, StructField("pos", IntegerType())]))
            trace = [r.asDict() for r in context.assemble(rows).collect()]
        included = sorted((r for r in trace if r["included"]), key=lambda r: r["place"])
        joined = "\n\n".join(r["block"] for r in included)
        shown = ("id", "repo_source", "file_path", "symbol_name", "kind", "start_line", "end_line", "language", "dense_rank", "lexical_rank", "fused_score", "included")
        yield {"type": "trace", "chunks": [{k: r[k] for k in shown if k in r} for r in trace], "retrieveMs": since(begun), "contextTokens": tokens_of(joined)}
        if not included:
            yield {"type": "token", "text": model.REFUSAL}
            yield {"type": "citations", "valid": [], "invalid": []}
            yield {"type": "done", "finishReason": "REFUSED", "generateMs": 0, "totalMs": since(begun)}
            return
        started, finish = time.monotonic(), "STOP"
        for piece, reason in generate(SYSTEM_PROMPT, build_contents(messages, joined)):
            deadline.check()
            said, finish = said + piece, reason or finish
            if piece:
                yield {"type": "token", "text": piece}
        if not said and finish == "MAX_TOKENS":
            yield {"type": "error", "message": "the output limit was reached before any text"}
            return
        yield {"type": "citations", **check_citations(spark, said, included)}
        yield {"type": "done", "finishReason": finish, "generateMs": since(started), "totalMs": since(begun)}
    except Cancelled:
        yield cancelled(since(begun), said)
    except Exception as problem:  # the stream must end with an event
        yield {"type": "error", "message": str(problem)} if deadline.left() else cancelled(since(begun), said)
    finally:
        spark.sparkContext.removeJobTag(deadline.tag)


def cancelled(elapsed_ms: int, said: str) -> dict:
    return {"type": "cancelled", "elapsedMs": elapsed_ms, "estimatedTokensNotGenerated": max(0, model.MAX_OUTPUT_TOKENS - tokens_of(said)), "note": "generation stopped by the client or the time limit"}


def check_citations(spark, text: str, included: Iterable[dict]) -> dict:
    answers = spark.createDataFrame([(0, text)], "k int, text string")
    known = spark.createDataFrame([(0, r["file_path"], r["start_line"], r["end_line"]) for r in included], "k int, file_path string, start_line int, end_line int")
    rows = cite.validate(cite.parse(answers, "k", "text"), known, "k").orderBy("place").collect()
    shown = [{"filePath": r.file_path, "startLine": r.start_line, "endLine": r.end_line, "raw": r.raw, "valid": r.valid, "reason": r.reason} for r in rows]
    return {"valid": [{k: v for k, v in r.items() if k not in ("valid", "reason")} for r in shown if r["valid"]], "invalid": [{"citation": {k: v for k, v in r.items() if k not in ("valid", "reason")}, "reason": r["reason"]} for r in shown if not r["valid"]]}


# --- server-sent events ---------------------------------------------------------------------------


def frame(event: dict) -> str:
    return f"data: {json.dumps(event, ensure_ascii=False)}\n\n"


def heartbeat() -> str:
    return ": ping\n\n"


def frames(events: Iterator[dict], deadline: Deadline | None = None, cancel: Callable[[], None] = lambda: None, heartbeat_seconds: float = model.HEARTBEAT_SECONDS, grace_seconds: float = 2.0) -> Iterator[str]:
    """Frames of the events, and a comment whenever none came for a while.

    The events are made in a thread of their own.  When the time is up or the client has gone, ``cancel``
    ends what that thread waits for; if it stays silent all the same, the stream ends without it.
    """
    made: queue.Queue = queue.Queue(maxsize=64)
    begun, said, end, stop = time.monotonic(), "", object(), threading.Event()

    def put(item) -> None:
        while not stop.is_set():
            try:
                return made.put(item, timeout=0.5)
            except queue.Full:
                continue

    def run() -> None:
        for event in events:
            if stop.is_set():
                return
            put(event)
        put(end)

    threading.Thread(target=run, daemon=True).start()
    last, ended_at = begun, None
    try:
        while True:
            now = time.monotonic()
            waits = [last + heartbeat_seconds - now]
            if ended_at is not None:
                waits.append(ended_at + grace_seconds - now)
            elif deadline is not None:
                waits.append(deadline.left())
            try:
                event = made.get(timeout=max(0.01, min(waits)))
            except queue.Empty:
                now = time.monotonic()
                if ended_at is not None and now >= ended_at + grace_seconds:
                    yield frame(cancelled(round((now - begun) * 1000), said))
                    return
                if ended_at is None and deadline is not None and not deadline.left():
                    ended_at = now
                    cancel()
                if now >= last + heartbeat_seconds:
                    yield heartbeat()
                    last = time.monotonic()
                continue
            if event is end:
                return
            said += event["text"] if event["type"] == "token" else ""
            yield frame(event)
            last = time.monotonic()
    finally:  # also when the reader has gone
        stop.set()
        if deadline is not None:
            deadline.closed = True
        cancel()


def parse_frames(reads: Iterable[str]) -> Iterator[dict]:
    """Events of a stream read in arbitrary pieces; comments and a cut-off last frame are dropped."""
    held = ""
    for piece in reads:
        held += piece
        *whole, held = held.split("\n\n")
        for one in whole:
            data = "\n".join(x.removeprefix("data:").lstrip(" ") for x in one.split("\n") if x.startswith("data:"))
            if data:
                yield json.loads(data)


def parse_frame_table(buffers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same for a table of whole streams: place and JSON of each event."""
    whole = buffers.select(id_col, F.posexplode(F.split(F.col(text_col), "\n\n")).alias("place", "frame"), F.size(F.split(F.col(text_col), "\n\n")).alias("n"))
    return whole.filter((F.col("place") < F.col("n") - 1) & F.col("frame").startswith("data:")).select(id_col, "place", F.regexp_replace("frame", "^data: ?", "").alias("event"))


def fold(events: Iterable[dict]) -> dict:
    """What a client shows after the events: status, text, trace, citations."""
    state = {"status": "streaming", "text": "", "trace": None, "citations": None, "error": None}
    for e in events:
        kind = e["type"]
        if kind == "token":
            state["text"] += e["text"]
        elif kind == "trace":
            state["trace"] = e["chunks"]
        elif kind == "citations":
            state["citations"] = {"valid": e["valid"], "invalid": e["invalid"]}
        elif kind in ("done", "cancelled", "error"):
            state["status"], state["error"] = kind, e.get("message")
    return state
