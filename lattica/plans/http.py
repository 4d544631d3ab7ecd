"""The service over HTTP, with the standard library: JSON in, JSON out; and its client calls.

An empty or incomplete payload answers 400, anything else that fails 500 with its message.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession

from ..functions import vectors as V
from ..sources.sinks import records
from . import service


def routes(spark: SparkSession, out: str | None = None) -> dict[tuple[str, str], Callable[[dict | None], dict[str, Any]]]:
    """(method, path) -> handler of the payload. `out`: folder in which the routes without `-get-result` save tables."""

    def saved(f):
        return lambda p: {"status": "success", "stats": f(spark, p, out)}

    def returned(f):
        return lambda p: {"status": "success", **f(spark, p)}

    def items(p):
        options = {k: v for k, v in (p or {}).items() if k in ("dim", "walk_length", "walks_per_node", "window", "p", "q", "epochs", "negatives", "lr", "batch", "seed")}
        return service.item_embeddings(spark, p, **options), options.get("dim", 64)

    def item_stats(p):
        found, _ = items(p)
        found = found.persist()
        service._save({"item_embeddings": found}, out)
        return {"status": "success", "stats": {"item_count": found.count()}}

    def item_rows(p):
        found, dim = items(p)
        rows = records(V.vector_to_wide(found, dim).orderBy("content_id"))
        return {"status": "success", "stats": {"item_count": len(rows)}, "item_embeddings": rows}

    return {
        ("GET", "/health"): lambda p: service.health(),
        ("POST", "/build-graph"): saved(service.build_graph),
        ("POST", "/build-graph-get-result"): returned(service.build_graph_get_result),
        ("POST", "/build-item-graph"): saved(service.build_item_graph),
        ("POST", "/build-item-graph-get-result"): returned(service.build_item_graph_get_result),
        ("POST", "/build-user-embeddings"): saved(service.build_user_embeddings),
        ("POST", "/build-user-embeddings-get-result"): returned(service.build_user_embeddings_get_result),
        ("POST", "/build-item-embeddings"): item_stats,
        ("POST", "/build-item-embeddings-get-result"): item_rows,
    }


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = 5000, out: str | None = None) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever(); requests share the session, not tables."""
    table = routes(spark, out)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                payload = json.loads(self.rfile.read(size)) if size else None
                handler = table.get((method, self.path.split("?", 1)[0]))
                code, body = (200, handler(payload)) if handler else (404, {"status": "error", "message": "no such route"})
            except ValueError as e:  # JSON that does not parse, or a payload without what is required
                code, body = 400, {"status": "error", "message": str(e)}
            except Exception as e:
                code, body = 500, {"status": "error", "message": str(e)[:2000]}
            raw = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self.answer("GET")

        def do_POST(self) -> None:
            self.answer("POST")

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def call(base: str, path: str, payload: dict | None = None, timeout: float = 600) -> tuple[int, dict]:
    """Status and JSON answer of one route; a payload makes it a POST."""
    body = None if payload is None else json.dumps(payload, ensure_ascii=False, default=str).encode()
    request = Request(base.rstrip("/") + path, data=body, headers={"Content-Type": "application/json"}, method="GET" if payload is None else "POST")
    try:
        with urlopen(request, timeout=timeout) as r:
            return r.status, json.loads(r.read())
    except HTTPError as e:
        return e.code, json.loads(e.read())


def call_build_graph(base: str, contents: list[dict], **tables: list[dict]) -> tuple[int, dict]:
    return call(base, "/build-graph", {"contents": contents, **tables})


def call_build_graph_get_result(base: str, contents: list[dict], **tables: list[dict]) -> tuple[int, dict]:
    return call(base, "/build-graph-get-result", {"contents": contents, **tables})
