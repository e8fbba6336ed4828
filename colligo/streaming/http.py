"""HTTP requests as a stream, with responses that go back to the request they answer.

A server on the driver takes requests into a queue; a micro-batch reads what has come, ``REQUESTS`` at most; the sink
``http.Send`` answers each request by its ``Id``. A request that no batch answers within ``timeout`` seconds gets 504. The
reader runs beside the driver and hands the rows to the tasks; requests of a batch that has been committed are dropped.
"""

from __future__ import annotations

import itertools
import json
import threading
from collections import deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Requests of one read.
REQUESTS = 10_000
SCHEMA = "Id bigint, Method string, Path string, Query string, ContentType string, Body string"


class RequestServer:
    """Requests in the order they came, and the answers they wait for. A request's number is its place in that order."""

    def __init__(self, port: int = 0, timeout: float = 30.0, host: str = "127.0.0.1"):
        self.requests: deque[tuple] = deque()
        self.dropped = 0
        self.waiting: dict[int, tuple[threading.Event, list]] = {}
        self.lock = threading.Lock()
        ids = itertools.count(1)
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self) -> None:
                url = urlsplit(self.path)
                size = int(self.headers.get("Content-Length") or 0)
                body = self.rfile.read(size).decode("utf-8", "replace") if size else ""
                ready, box = threading.Event(), []
                with outer.lock:
                    i = next(ids)
                    outer.waiting[i] = (ready, box)
                    outer.requests.append((i, self.command, url.path, url.query, self.headers.get("Content-Type"), body))
                done = ready.wait(timeout)
                outer.waiting.pop(i, None)
                status, kind, text = box[0] if done else (504, "text/plain", "no answer")
                data = (text or "").encode("utf-8")
                self.send_response(status)
                self.send_header("Content-Type", kind or "text/plain")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = answer  # noqa: N815

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def taken(self, since: int, most: int = REQUESTS) -> list[tuple]:
        """Requests from number ``since`` on."""
        with self.lock:
            begin = max(0, since - self.dropped)
            return list(itertools.islice(self.requests, begin, begin + most))

    def drop(self, before: int) -> None:
        """Forgets the requests with numbers below ``before``."""
        with self.lock:
            while self.requests and self.dropped < before:
                self.requests.popleft()
                self.dropped += 1

    def respond(self, request: int, status: int, body: str | None, content_type: str | None = None) -> None:
        found = self.waiting.get(request)
        if found:
            found[1].append((status, content_type, body))
            found[0].set()

    def send(self, df: DataFrame, _: int, *args) -> None:
        """Sink: rows with ``Id, Status, Body`` and maybe ``ContentType`` (or a struct column ``value`` of these)."""
        for row in df.toLocalIterator():
            r = row.asDict(recursive=True)
            self.respond(r["Id"], int(r.get("Status") or 200), r.get("Body"), r.get("ContentType"))

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


def _ask(port: int, method: str, number: int) -> bytes:
    from http.client import HTTPConnection

    c = HTTPConnection("127.0.0.1", port, timeout=10)
    c.request(method, f"/?number={number}")
    return c.getresponse().read()


class _Control:
    """A second port that lists and drops requests for the reader, which runs in a process of its own beside the driver."""

    def __init__(self, server: RequestServer):
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                self.reply(json.dumps(server.taken(self.number())).encode())

            def do_DELETE(self) -> None:  # noqa: N802
                server.drop(self.number())
                self.reply(b"")

            def number(self) -> int:
                return int(urlsplit(self.path).query.partition("=")[2] or 0)

            def reply(self, data: bytes) -> None:
                self.send_response(200)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, port: int):
        self.port = port

    def initialOffset(self):  # noqa: N802
        return {"n": 0}

    def read(self, start):
        rows = self.fetch(start["n"])
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start, end):  # noqa: N802
        return iter(self.fetch(start["n"])[: end["n"] - start["n"]])

    def fetch(self, since: int) -> list[tuple]:
        return [tuple(r) for r in json.loads(_ask(self.port, "GET", since))]

    def commit(self, end):
        _ask(self.port, "DELETE", end["n"])


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "colligo_http"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Reader(int(self.options["control"]))


def receive(spark: SparkSession, server: RequestServer) -> DataFrame:
    """The stream of a server's requests."""
    spark.dataSource.register(HttpSource)
    control = _Control(server)
    return spark.readStream.format("colligo_http").option("control", control.port).load()
