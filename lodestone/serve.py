"""A small HTTP front: collections, answers, and answers as server-sent events.

The heavy lifting is a function from (question, collection, topic codes) to an
answer, such as ``cli.run_ask`` over a warm session.  A second one may yield the
answer's pieces as they come (as ``transports.HttpLlm.stream`` does) and then
the answer; without it the whole text is one piece.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lodestone.sources.collections import Registry

Ask = Callable[[str, str, list[str]], dict]
Stream = Callable[[str, str, list[str]], Iterator[str | dict]]
MAX_BYTES = 64 * 1024


class BadRequest(ValueError):
    pass


def checked(body: bytes) -> tuple[str, str, list[str]]:
    """Question (3 to 500 characters), collection and at most 8 topic codes of a request."""
    try:
        data = json.loads(body or b"{}")
    except ValueError as e:
        raise BadRequest("the body is no JSON") from e
    question = str(data.get("question") or "").strip()
    if not 3 <= len(question) <= 500:
        raise BadRequest("a question of 3 to 500 characters is needed")
    codes = data.get("topicCodes") or []
    if not isinstance(codes, list) or len(codes) > 8:
        raise BadRequest("at most 8 topic codes")
    return question, str(data.get("collection") or ""), [str(c) for c in codes]


def make_server(registry: Registry, available: Callable[[], list[str]], ask: Ask, port: int = 0, stream: Stream | None = None) -> ThreadingHTTPServer:
    def pieces(question: str, collection: str, codes: list[str]) -> Iterator[str | dict]:
        if stream is not None:
            yield from stream(question, collection, codes)
        else:
            answer = ask(question, collection, codes)
            yield answer.get("text", "")
            yield answer

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def reply(self, status: int, data: dict | list, kind: str = "application/json") -> None:
            raw = json.dumps(data, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("content-type", f"{kind}; charset=utf-8")
            self.send_header("content-length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path != "/api/collections":
                return self.reply(404, {"error": "not found"})
            there = set(available())
            return self.reply(200, [{"id": c.id, "label": c.label, "language": c.language} for c in registry.all if c.id in there])

        def do_POST(self) -> None:
            if self.path not in ("/api/ask", "/api/ask-stream"):
                return self.reply(404, {"error": "not found"})
            size = int(self.headers.get("content-length") or 0)
            try:
                if size > MAX_BYTES:
                    raise BadRequest("the request is too large")
                question, collection, codes = checked(self.rfile.read(size))
            except BadRequest as e:
                return self.reply(400, {"error": str(e)})
            if self.path == "/api/ask":
                try:
                    return self.reply(200, ask(question, registry.get(collection).id, codes))
                except Exception as e:  # noqa: BLE001  the client gets the reason
                    return self.reply(500, {"error": str(e)})
            self.send_response(200)
            self.send_header("content-type", "text/event-stream; charset=utf-8")
            self.end_headers()
            try:
                for piece in pieces(question, registry.get(collection).id, codes):
                    if isinstance(piece, str):
                        self.event("token", {"text": piece})
                    else:
                        self.event("done", piece)
            except Exception as e:  # noqa: BLE001
                self.event("error", {"error": str(e)})
            return None

        def event(self, name: str, data: dict) -> None:
            self.wfile.write(f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False, default=str)}\n\n".encode())
            self.wfile.flush()

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
