"""Command line: build, query, query-batch, daemon, version. Exit 2 for wrong usage, 1 for any other error."""

from __future__ import annotations

import argparse
import signal
import sys
import time

from pyspark.sql import SparkSession

from needlebed.functions.sizes import format_bytes, parse_size
from needlebed.plans.index import BuildOptions, Index, Progress, build
from needlebed.plans.service import DaemonConfig, Live, RebuildRunner, load_config, serve, too_long
from needlebed.sources.tables import split_lines

VERSION = "0.1.0"
DEFAULT_INDEX = "corpus.index"


class TooLong(ValueError):
    """A needle that the index can't answer for."""


def check_length(needle: bytes, limit: int, what: str = "query") -> None:
    if limit and len(needle) > limit:
        raise TooLong(too_long(what, needle, limit))


def needle_from(words: list[str], stdin: bool, file: str | None) -> bytes:
    """The one needle that is given: words joined by blanks, or the very bytes of standard input or a file."""
    if bool(words) + stdin + bool(file) != 1:
        raise ValueError("give the query as words, with --stdin, or with --file, in one way only")
    if file:
        with open(file, "rb") as f:
            return f.read()
    return sys.stdin.buffer.read() if stdin else " ".join(words).encode(errors="surrogateescape")


def batch_answers(index, lines: list[bytes]):
    """TRUE or FALSE for each line, in order. An over-long line is an error after the answers before it, which are
    worked out together."""
    limit = index.max_query_bytes()
    stop = next((i for i, n in enumerate(lines) if limit and len(n) > limit), len(lines))
    yield from ("TRUE" if hit else "FALSE" for hit in index.contains_all(lines[:stop]))
    if stop < len(lines):
        check_length(lines[stop], limit, f"query line {stop + 1}")


def progress_line(p: Progress, verbose: bool, seconds: float) -> str:
    line = p.message or p.phase
    if p.total > 0:
        line += f" {p.current}/{p.total}"
    elif p.total_bytes > 0:
        line += f" {format_bytes(p.current_bytes)}/{format_bytes(p.total_bytes)}"
    elif p.current_bytes > 0:
        line += f" {format_bytes(p.current_bytes)}"
    if verbose and p.path:
        line += f" {p.path}"
    return line + (f" elapsed={int(seconds)}s" if seconds > 0 else "")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="needlebed", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    b = verbs.add_parser("build")
    b.add_argument("-r", dest="recursive", action="store_true")
    b.add_argument("-o", dest="out", default=DEFAULT_INDEX)
    b.add_argument("-memory-limit", "--memory-limit", default="512M")
    b.add_argument("-max-query-bytes", "--max-query-bytes", default="1M")
    b.add_argument("-jobs", "--jobs", type=int, default=0)
    b.add_argument("--silent", action="store_true")
    b.add_argument("--verbose", action="store_true")
    b.add_argument("paths", nargs="+")
    q = verbs.add_parser("query")
    q.add_argument("-i", dest="index", default=DEFAULT_INDEX)
    q.add_argument("--stdin", action="store_true")
    q.add_argument("--file")
    q.add_argument("words", nargs="*")
    m = verbs.add_parser("query-batch")
    m.add_argument("-i", dest="index", default=DEFAULT_INDEX)
    m.add_argument("--file")
    d = verbs.add_parser("daemon")
    d.add_argument("--config")
    d.add_argument("-i", dest="index")
    d.add_argument("--bind")
    d.add_argument("--port", type=int)
    verbs.add_parser("version")
    return top


def session() -> SparkSession:
    spark = SparkSession.builder.appName("needlebed").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> None:
    if args.verb == "version":
        print(f"version={VERSION}")
        return
    if args.verb == "query":
        needle = needle_from(args.words, args.stdin, args.file)
    if args.verb == "daemon":
        config = load_config(args.config).with_flags(args.index, args.bind, args.port)
    spark = spark or session()
    if args.verb == "build":
        began = time.monotonic()
        tell = None if args.silent else lambda p: print(progress_line(p, args.verbose, time.monotonic() - began), file=sys.stderr)
        m = build(spark, args.paths, args.out, BuildOptions(args.recursive, parse_size(args.memory_limit), parse_size(args.max_query_bytes), args.jobs), tell)
        for key, value in (("indexed_files", m.file_count), ("total_bytes", m.total_bytes), ("sha256", m.sha256), ("shards", m.shard_count), ("memory_limit", m.memory_limit), ("max_query_bytes", m.max_query_bytes), ("jobs", m.jobs), ("shard_size", m.shard_size), ("index", args.out), ("meta", f"{args.out}/manifest")):
            print(f"{key}={value}")
    elif args.verb == "query":
        index = Index(spark, args.index)
        check_length(needle, index.max_query_bytes())
        print("TRUE" if index.contains_bytes(needle) else "FALSE")
    elif args.verb == "query-batch":
        index = Index(spark, args.index)
        if args.file:
            with open(args.file, "rb") as f:
                data = f.read()
        else:
            data = sys.stdin.buffer.read()
        for answer in batch_answers(index, split_lines(data)):
            print(answer)
    else:
        daemon(spark, config)


def daemon(spark: SparkSession, config: DaemonConfig) -> None:
    live = Live(spark, config.index_path)
    if hasattr(signal, "SIGHUP"):
        signal.signal(signal.SIGHUP, lambda *_: live.try_reload())
    server = serve(live, config, RebuildRunner(config.rebuild_command) if config.rebuild_command else None)
    print(f"listening on http://{config.bind}:{server.server_address[1]} index={config.index_path}", file=sys.stderr)
    server.serve_forever()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args, spark)
    except Exception as e:  # the end of the program: any error is its message and a status
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
