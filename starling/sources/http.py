"""A thin HTTP face of a Client, for tools that speak JSON. Spark does the work; one writer at a time."""

from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from starling import errors
from starling.sources.collection import Client


class Api:
    """Routes and what they do: each handler takes the path's names and the request's body, and returns JSON."""

    def __init__(self, client: Client):
        self.client, self.lock = client, threading.Lock()
        self.routes = [
            ("POST", r"/collections", self.create),
            ("GET", r"/collections", lambda body: self.client.list_collections()),
            ("DELETE", r"/collections/(?P<name>[^/]+)", lambda body, name: {"deleted": self.client.delete_collection(name)}),
            ("POST", r"/collections/(?P<name>[^/]+)/add", self.add),
            ("POST", r"/collections/(?P<name>[^/]+)/upsert", self.upsert),
            ("POST", r"/collections/(?P<name>[^/]+)/add_many", self.add_many),
            ("POST", r"/collections/(?P<name>[^/]+)/search", self.search),
            ("GET", r"/collections/(?P<name>[^/]+)/get/(?P<id>[^/]+)", self.get),
            ("DELETE", r"/collections/(?P<name>[^/]+)/delete/(?P<id>[^/]+)", lambda body, name, id: {"deleted": self._open(name).delete(id)}),
            ("POST", r"/collections/(?P<name>[^/]+)/save", self.save),
            ("GET", r"/collections/(?P<name>[^/]+)/stats", lambda body, name: self._open(name).stats()),
        ]

    def _open(self, name: str):
        return self.client.get_collection(name)

    def create(self, body):
        self.client.create_collection(body["name"], body["dim"], body.get("metric") or "cosine", bool(body.get("quantize")))
        return {"created": body["name"]}

    def add(self, body, name):
        self._open(name).add(body["id"], body["vector"], body.get("metadata"))
        return {"added": body["id"]}

    def upsert(self, body, name):
        self._open(name).upsert(body["id"], body["vector"], body.get("metadata"))
        return {"upserted": body["id"]}

    def add_many(self, body, name):
        self._open(name).add_many(body["ids"], body["vectors"], body.get("metadatas"))
        return {"added": len(body["ids"])}

    def search(self, body, name):
        k = body.get("k")
        found = self._open(name).search(body["vector"], 10 if k is None else k, body.get("ef_search"), body.get("filter"), body.get("max_distance"))
        return [{"id": r["id"], "distance": r["distance"], "metadata": None if r["metadata"] is None else json.loads(r["metadata"])} for r in found.collect()]

    def get(self, body, name, id):
        vector, metadata = self._open(name).get(id)
        return {"id": id, "vector": vector, "metadata": metadata}

    def save(self, body, name):
        self._open(name).save()
        return {"saved": name}

    def handle(self, method: str, path: str, body: bytes) -> tuple[int, object]:
        path = urlsplit(path).path
        for verb, pattern, handler in self.routes:
            m = re.fullmatch(pattern, path)
            if verb == method and m:
                try:
                    names = {k: unquote(v) for k, v in m.groupdict().items()}
                    given = json.loads(body) if body else {}
                    if method == "GET" or path.endswith("/search"):
                        return 200, handler(given, **names)
                    with self.lock:
                        return 200, handler(given, **names)
                except (errors.NotFound, errors.DatabaseNotFound) as e:
                    return 404, {"error": str(e)}
                except (ValueError, KeyError, TypeError) as e:
                    return 400, {"error": str(e)}
                except Exception as e:  # the server goes on
                    return 500, {"error": str(e)[:500]}
        return 404, {"error": f"no route {method} {path}"}


def serve(client: Client, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't running yet: call serve_forever(), and shutdown() to end it."""
    api = Api(client)

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            status, out = api.handle(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
