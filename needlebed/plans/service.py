"""Lookups over HTTP: one index that can be reloaded while it is asked."""

from __future__ import annotations

import subprocess
import sys
import threading
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from needlebed.errors import IndexFormatError
from needlebed.plans.index import Index
from needlebed.sources.tables import split_lines


@dataclass(frozen=True)
class DaemonConfig:
    index_path: str = "corpus.index"
    bind: str = "127.0.0.1"
    port: int = 8080
    rebuild_command: str = ""

    def with_flags(self, index: str | None, bind: str | None, port: int | None) -> DaemonConfig:
        """Flags that are given go before the file's values; the result is checked."""
        flags = {"index_path": index, "bind": bind, "port": port}
        out = replace(self, **{k: v for k, v in flags.items() if v is not None})
        if not out.index_path or not out.bind:
            raise ValueError("index path and bind address must not be empty")
        check_port(out.port)
        return out


def check_port(port: int) -> int:
    if not 1 <= port <= 65535:
        raise ValueError(f"port {port} is outside 1 to 65535")
    return port


def load_config(path: str | None) -> DaemonConfig:
    """A file of ``key = value`` lines; lines that are empty or start with # say nothing, an unknown key is an error."""
    config = DaemonConfig()
    if not path:
        return config
    with open(path, encoding="utf-8") as f:
        lines = f.read().split("\n")
    for number, line in enumerate(map(str.strip, lines), 1):
        if not line or line.startswith("#"):
            continue
        key, sign, value = line.partition("=")
        key, value = key.strip(), value.strip().strip('"')
        try:
            if not sign:
                raise ValueError("key=value is expected")
            if key in ("index", "index_path", "bind") and not value:
                raise ValueError(f"{key} must not be empty")
            if key in ("index", "index_path"):
                config = replace(config, index_path=value)
            elif key in ("bind", "rebuild_command"):
                config = replace(config, **{key: value})
            elif key == "port":
                config = replace(config, port=check_port(int(value)))
            else:
                raise ValueError(f"unknown key {key!r}")
        except ValueError as e:
            raise ValueError(f"{path}, line {number}: {e}") from e
    return config


class Live:
    """The index at a path. A reload that fails leaves what was open; lookups under way end on the index they began."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.index = Index(spark, path)

    def reload(self) -> None:
        self.index = Index(self.spark, self.path)

    def try_reload(self) -> bool:
        try:
            self.reload()
        except IndexFormatError as e:
            print(f"reload failed, the old index stays: {e}", file=sys.stderr)
            return False
        return True

    def contains_bytes(self, needle: bytes) -> bool:
        return self.index.contains_bytes(needle)

    def contains_all(self, needles: list[bytes]) -> list[bool]:
        return self.index.contains_all(needles)

    def max_query_bytes(self) -> int:
        return self.index.max_query_bytes()


class RebuildRunner:
    """Runs the configured command, once at a time, in the background."""

    def __init__(self, command: str):
        self.command, self.lock = command, threading.Lock()
        self.running, self.started, self.finished, self.error = False, None, None, ""
        self.thread: threading.Thread | None = None

    def start(self) -> bool:
        with self.lock:
            if self.running:
                return False
            self.running, self.started, self.finished, self.error = True, datetime.now(timezone.utc), None, ""
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return True

    def _run(self) -> None:
        done = subprocess.run(["/bin/sh", "-c", self.command], capture_output=True)
        sys.stderr.write((done.stdout + done.stderr).decode(errors="replace"))
        with self.lock:
            self.running, self.finished = False, datetime.now(timezone.utc)
            self.error = f"exit status {done.returncode}" if done.returncode else ""

    def status(self) -> str:
        with self.lock:
            lines = [f"status={'running' if self.running else 'idle'}"]
            for name, at in (("last_started", self.started), ("last_finished", self.finished)):
                if at:
                    lines.append(f"{name}={at.isoformat(timespec='seconds')}")
            if self.error:
                lines.append(f"last_error={self.error}")
        return "".join(x + "\n" for x in lines)


def too_long(what: str, needle: bytes, limit: int) -> str:
    return f"{what} is {len(needle)} bytes; this index takes at most {limit}"


def respond(live, rebuild: RebuildRunner | None, method: str, target: str, body: bytes) -> tuple[int, str]:
    """Status and text for a request."""
    url = urlsplit(target)
    allowed = {"/health": ("GET",), "/query": ("GET", "POST"), "/query-batch": ("POST",)} | ({"/rebuild": ("GET", "POST")} if rebuild else {})
    if url.path not in allowed:
        return 404, "not found\n"
    if method not in allowed[url.path]:
        return 405, "method not allowed\n"
    limit = live.max_query_bytes() if url.path.startswith("/query") else 0
    if url.path == "/health":
        return 200, "OK\n"
    if url.path == "/query":
        needle = body if method == "POST" else parse_qs(url.query, keep_blank_values=True, encoding="latin-1").get("q", [""])[0].encode("latin-1")
        if not needle:
            return 400, "query is empty\n"
        if limit and len(needle) > limit:
            return 413, too_long("query", needle, limit) + "\n"
        return 200, "TRUE\n" if live.contains_bytes(needle) else "FALSE\n"
    if url.path == "/query-batch":
        lines = split_lines(body)
        for number, needle in enumerate(lines, 1):
            if limit and len(needle) > limit:
                return 400, too_long(f"query line {number}", needle, limit) + "\n"
        return 200, "".join("TRUE\n" if hit else "FALSE\n" for hit in live.contains_all(lines))
    if method == "GET":
        return 200, rebuild.status()
    return (202, "rebuild started\n") if rebuild.start() else (409, "rebuild already running\n")


def serve(live, config: DaemonConfig, rebuild: RebuildRunner | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        timeout = 5

        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, text = respond(live, rebuild, self.command, self.path, body)
            except Exception as e:  # a failed lookup is an error, never FALSE
                status, text = 500, f"{e}\n"
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = do_HEAD = do_PATCH = answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((config.bind, config.port), Handler)
