"""HTTP front of the engine (standard library): chat as server-sent events, source ranges, health.

``POST /api/chat``    {messages, repoSource?, topK?} -> events
``GET  /api/source``  repoSource, filePath, startLine, endLine -> blocks and gaps
``GET  /health``, ``GET /ready``

``python -m quillspark.server`` reads the settings from the environment and serves until it is told to
stop; then it is not ready any more, takes no new requests and lets the open ones end.
"""

from __future__ import annotations

import json
import signal
import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from . import model
from .functions.stem import stem
from .operators import index, postings, source_window
from .sources import config, store
from .streaming import answer


class BadRequest(ValueError):
    """The request cannot be read; the message says why."""


def chat_request(body: bytes) -> tuple[list[dict], model.SearchOptions]:
    try:
        data = json.loads(body)
    except ValueError as problem:
        raise BadRequest("body: expected JSON") from problem
    messages = data.get("messages") if isinstance(data, dict) else None
    if not isinstance(messages, list) or not messages or any(not isinstance(m, dict) or m.get("role") not in ("user", "assistant") or not isinstance(m.get("content"), str) or not m["content"] for m in messages):
        raise BadRequest("messages: expected at least one {role, content}")
    repo, top_k = data.get("repoSource"), data.get("topK", model.TOP_K)
    if repo is not None and (not isinstance(repo, str) or not repo):
        raise BadRequest("repoSource: expected a string that is not empty")
    if not isinstance(top_k, int) or isinstance(top_k, bool) or top_k < 1:
        raise BadRequest("topK: expected a positive integer")
    return messages, model.SearchOptions(repo_source=repo, top_k=top_k)


def source_request(query: str) -> dict:
    given = {k: v[-1] for k, v in parse_qs(query).items()}
    out: dict = {}
    for name in ("repoSource", "filePath"):
        if not given.get(name):
            raise BadRequest(f"{name}: required")
        out[name] = given[name]
    for name in ("startLine", "endLine"):
        if not given.get(name, "").isdigit() or int(given[name]) < 1:
            raise BadRequest(f"{name}: expected a positive integer")
        out[name] = int(given[name])
    if out["endLine"] < out["startLine"]:
        raise BadRequest("endLine: before startLine")
    return out


@dataclass
class Engine:
    """What the routes need; ``chunks`` is read anew for each request, so replaced rows are seen."""

    spark: SparkSession
    chunks: Callable[[], DataFrame]
    embed: Callable[[Sequence[str]], list[list[float]]]
    generate: Callable = field(default_factory=answer.Extractive)
    is_ready: Callable[[], bool] = lambda: True
    shutting_down: bool = False
    stems: Callable[[str], str] | None = stem  # as the table was indexed
    lexical_index: Callable[[str | None], str | None] = lambda repo: None  # folder of the inverted index, where it covers what is asked for

    def chat(self, body: bytes, deadline: answer.Deadline):
        messages, options = chat_request(body)
        events = answer.answer(self.chunks(), messages, self.embed, self.generate, options, deadline, self.stems, self.lexical_index(options.repo_source))
        return answer.frames(events, deadline, lambda: self.spark.sparkContext.cancelJobsWithTag(deadline.tag))

    def source(self, query: str) -> dict | None:
        """Blocks and gaps of one range, or None where nothing is stored."""
        q = source_request(query)
        asked = self.spark.createDataFrame([(0, q["repoSource"], q["filePath"], q["startLine"], q["endLine"])], "request_id int, repo_source string, file_path string, start_line int, end_line int")
        chunks = self.chunks()
        stored = chunks.filter((chunks.repo_source == q["repoSource"]) & (chunks.file_path == q["filePath"]))  # reaches the scan
        found = source_window.blocks(stored, asked)
        blocks = found.orderBy("start_line", "part_index").select("start_line", "end_line", "kind", "symbol_name", "content").collect()  # one file's range of at most 400 lines
        if not blocks:
            return None
        gaps = sorted((g.start_line, g.end_line) for g in source_window.gaps(found, asked).collect())
        return {
            "filePath": q["filePath"], "startLine": q["startLine"], "endLine": min(q["endLine"], q["startLine"] + model.MAX_SOURCE_LINES - 1),
            "blocks": [{"startLine": b.start_line, "endLine": b.end_line, "kind": b.kind, "symbolName": b.symbol_name, "content": b.content} for b in blocks],
            "gaps": [{"startLine": a, "endLine": b} for a, b in gaps],
        }


def serve(engine: Engine, port: int = 8080, host: str = "0.0.0.0") -> ThreadingHTTPServer:
    """A server that is not started yet: call serve_forever(), and shutdown() to drain."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def _json(self, status: int, data: dict) -> None:
            raw = json.dumps(data, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _guarded(self, run: Callable[[], None]) -> None:
            try:
                run()
            except BadRequest as problem:
                self._json(400, {"error": str(problem)})
            except (BrokenPipeError, ConnectionResetError):
                pass
            except Exception:  # the only place where an unexpected error becomes a response
                self._json(500, {"error": "internal error"})

        def do_GET(self) -> None:
            self._guarded(self._get)

        def do_POST(self) -> None:
            self._guarded(self._post)

        def _get(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/health":
                self._json(200, {"status": "ok"})
            elif url.path == "/ready":
                ok = not engine.shutting_down and engine.is_ready()
                self._json(200 if ok else 503, {"status": "ready" if ok else "not ready"})
            elif url.path == "/api/source":
                found = engine.source(url.query)
                self._json(200, found) if found else self._json(404, {"error": "no such source"})
            else:
                self._json(404, {"error": "no such route"})

        def _post(self) -> None:
            if urlsplit(self.path).path != "/api/chat":
                return self._json(404, {"error": "no such route"})
            deadline = answer.Deadline()
            frames = engine.chat(self.rfile.read(int(self.headers.get("Content-Length") or 0)), deadline)
            self.send_response(200)
            for name, value in (("Content-Type", "text/event-stream"), ("Cache-Control", "no-cache, no-transform"), ("X-Accel-Buffering", "no")):
                self.send_header(name, value)
            self.end_headers()
            try:
                for frame in frames:
                    self.wfile.write(frame.encode())
                    self.wfile.flush()
            except (BrokenPipeError, ConnectionResetError):
                pass  # the client went away before the end
            finally:
                frames.close()  # ends the request's jobs

    return ThreadingHTTPServer((host, port), Handler)


def engine_of(spark: SparkSession, settings: config.Settings) -> Engine:
    """An engine over the stored table; it is ready when no expected migration is missing in the ledger."""
    table, ledger = f"{settings.table_uri}/chunks", f"{settings.table_uri}/migrations"

    def is_ready() -> bool:
        expected = spark.createDataFrame([(name,) for name in config.MIGRATIONS], "name string")
        return config.ready(expected, config.applied_migrations(spark, ledger), False)

    def lexical_index(repo: str | None) -> str | None:
        folder = f"{settings.table_uri}/postings"
        return folder if postings.covers(spark, folder, table, repo) else None

    return Engine(spark, lambda: store.read_chunks(spark, table), index.HashingEmbedder(), is_ready=is_ready, lexical_index=lexical_index)


def drain(server: ThreadingHTTPServer, engine: Engine) -> None:
    """Stop taking requests; those that are open end by themselves or at their time limit."""
    engine.shutting_down = True
    server.shutdown()


def main(spark: SparkSession | None = None) -> int:
    try:
        settings = config.load()
    except ValueError as problem:
        print(problem)
        return 1
    spark = spark or SparkSession.builder.appName("quillspark-server").getOrCreate()
    config.record_migrations(spark, f"{settings.table_uri}/migrations")
    engine = engine_of(spark, settings)
    server = serve(engine, settings.port)
    server.daemon_threads = False  # server_close() waits for open requests
    for one in (signal.SIGTERM, signal.SIGINT):
        signal.signal(one, lambda *_: threading.Thread(target=drain, args=(server, engine)).start())
    server.serve_forever()
    server.server_close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
