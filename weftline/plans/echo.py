"""A small HTTP server for the registered fetch queries: it answers by the path, on the driver's address."""

from __future__ import annotations

import http.server
import mmap
import os
import socket
import subprocess
import sys
import tempfile
import threading
import zlib
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

#: Processes that answer at one address, and places to note paths in that have been asked for (a sparse file).
WORKERS, NOTES = max(1, min(8, (os.cpu_count() or 2) // 2)), 1 << 30


class _Handler(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    failed: mmap.mmap

    def _first(self) -> bool:
        """Whether nobody asked for the path before; the processes share the notes."""
        number = self.path.rpartition("/")[2]
        place = (int(number) if number.isdecimal() else zlib.crc32(self.path.encode())) % NOTES
        was, self.failed[place] = self.failed[place], 1
        return not was

    def _answer(self) -> None:
        sent = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        kind = self.path.split("/")[1]
        if kind == "flaky" and self._first():
            # The first request of such a path gets no answer.
            self.close_connection = True
            return
        status, more, body = 200, {}, f"{self.command} {self.path}{' ' if sent else ''}{sent}"
        if kind == "status":
            status = int(self.path.split("/")[2])
        elif kind == "moved":
            status, more, body = 302, {"Location": f"/ok/{self.path.split('/')[2]}"}, "moved"
        elif kind == "big":
            body = "x" * 5000
        elif kind == "headers":
            body = "|".join(f"{k}={self.headers.get(k)}" for k in ("x-one", "x-two", "user-agent", "sec-fetch-mode"))
        data = body.encode()
        self.send_response(status)
        for k, v in ({"Content-Type": "text/plain; charset=utf-8", "Content-Length": str(len(data))} | more).items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(data)

    do_GET = do_POST = do_PUT = do_DELETE = _answer

    def log_message(self, *_: object) -> None:
        pass


def _serve(listening: int, notes: int) -> None:
    """One of the processes; it ends with the one that started it, when its standard input does."""
    _Handler.failed = mmap.mmap(notes, NOTES)
    server = http.server.ThreadingHTTPServer(("", 0), _Handler, bind_and_activate=False)
    server.socket = socket.socket(fileno=listening)
    # All of them are woken by a connection that one of them gets.
    server.socket.setblocking(False)
    server.get_request = lambda: (lambda c: (c[0].setblocking(True), c)[1])(server.socket.accept())
    threading.Thread(target=lambda: (sys.stdin.buffer.read(), os._exit(0)), daemon=True).start()
    server.serve_forever()


_servers: tuple[str, int, list[subprocess.Popen]] | None = None


def base(spark: SparkSession) -> str:
    """The server's address; it is started once a process and ends with it."""
    global _servers
    if _servers is None:
        host = spark.conf.get("spark.driver.host", "127.0.0.1")
        with socket.create_server((host, 0), backlog=1024) as listening, tempfile.TemporaryFile() as notes:
            notes.truncate(NOTES)
            given = (listening.fileno(), notes.fileno())
            run = [sys.executable, "-P", os.path.abspath(__file__), *map(str, given)]
            _servers = host, listening.getsockname()[1], [subprocess.Popen(run, stdin=subprocess.PIPE, pass_fds=given) for _ in range(WORKERS)]
    return f"http://{_servers[0]}:{_servers[1]}"


if __name__ == "__main__":
    _serve(int(sys.argv[1]), int(sys.argv[2]))
