"""Records that are posted over HTTP."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .queues import FullQueue, QueueSource


class WebhookSource(QueueSource):
    """POST JSON to ``url``: a list is as many records as it has elements, no body is one null record.

    Answers: 202 taken, 400 not JSON, 404 another path (slashes at the ends and parameters aside), 503 no room in time.
    """

    def __init__(self, host: str = "127.0.0.1", port: int = 0, path: str = "/events", *, push_timeout: float = 5.0, **queue):
        super().__init__(**queue)
        source = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                if self.path.split("?")[0].strip("/") != path.strip("/"):
                    return self.answer(404)
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                try:
                    found = json.loads(body) if body.strip() else None
                except ValueError:
                    return self.answer(400)
                try:
                    for record in found if isinstance(found, list) else [found]:
                        source.push(record, timeout=push_timeout)
                except FullQueue:
                    return self.answer(503)
                return self.answer(202)

            def answer(self, code: int) -> None:
                self.send_response(code)
                self.send_header("Content-Length", "0")
                self.end_headers()

            def log_message(self, *args) -> None:
                pass

        self._server = ThreadingHTTPServer((host, port), Handler)
        self._path = path

    @property
    def url(self) -> str:
        host, port = self._server.server_address[:2]
        return f"http://{host}:{port}{self._path}"

    def start(self) -> WebhookSource:
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()
        super().close()
