"""A thin HTTP service over answer(): /health, /config, /examples, /ask."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from .answer import Retriever, answer


class Service:
    """Answers one question a request.  Until a retriever is set, asking replies 503; a failing generator replies 502."""

    def __init__(self, examples: list[str], generate: Callable[[DataFrame], DataFrame] | None = None, host: str = "127.0.0.1", port: int = 0):
        self.examples, self.options = examples, {"generate": generate} if generate else {}
        self.retriever: Retriever | None = None
        service = self

        class Handler(BaseHTTPRequestHandler):
            def reply(self, status: int, body: dict) -> None:
                data = json.dumps(body, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                self.reply(*service.get(self.path))

            def do_POST(self) -> None:
                try:
                    body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                except ValueError:
                    return self.reply(400, {"detail": "the body is not JSON"})
                self.reply(*(service.ask(body) if self.path == "/ask" else (404, {"detail": "unknown path"})))

            def log_message(self, *_) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]

    def get(self, path: str) -> tuple[int, dict]:
        ready = self.retriever is not None
        if path == "/health":
            return 200, {"status": "ok" if ready else "starting"}
        if path == "/examples":
            return 200, {"examples": self.examples}
        if path == "/config":
            return (200, self.retriever.config.row()) if ready else (503, {"detail": "starting"})
        return 404, {"detail": "unknown path"}

    def ask(self, body: dict) -> tuple[int, dict]:
        question = str(body.get("question") or "").strip()
        if not question:
            return 422, {"detail": "a question is needed"}
        if self.retriever is None:
            return 503, {"detail": "starting"}
        spark = self.retriever.spark
        try:
            rows = answer(spark.createDataFrame([(0, question)], "query_id long, question string"), self.retriever, **self.options).collect()  # one row
        except Exception as e:
            return 502, {"detail": f"the answer failed: {type(e).__name__}"}
        out = rows[0].asDict()
        if out.get("error"):
            return 502, {"detail": out["error"]}
        return 200, out

    def start(self) -> Service:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()
