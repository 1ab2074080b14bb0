"""Command line and HTTP service."""

import io
import sys
import threading
import urllib.error
import urllib.request

import pytest

from needlebed import cli
from needlebed.plans import service
from needlebed.plans.index import Progress


class Fake:
    def __init__(self, hits, limit=1024):
        self.hits, self.limit = set(hits), limit

    def contains_bytes(self, n):
        return n in self.hits

    def contains_all(self, ns):
        return [n in self.hits for n in ns]

    def max_query_bytes(self):
        return self.limit


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    (top / "in").mkdir()
    (top / "in" / "a").write_bytes(b"base64_decode(x); 100\n")
    (top / "in" / "b").write_bytes(b"json(y)" * 10)
    assert cli.main(["build", "-o", f"{top}/index", "-memory-limit", "4K", "-max-query-bytes", "16", "--silent", f"{top}/in"], spark) == 0
    return top


def test_build_reports(built, spark, capsys):
    assert cli.main(["build", "-r", "-o", f"{built}/again", "--verbose", f"{built}/in"], spark) == 0
    out, err = capsys.readouterr()
    keys = [x.partition("=")[0] for x in out.splitlines()]
    assert keys == ["indexed_files", "total_bytes", "sha256", "shards", "memory_limit", "max_query_bytes", "jobs", "shard_size", "index", "meta"]
    assert "indexed_files=2" in out and "total_bytes=92" in out and "packing" in err


def test_query(built, spark, capsys, monkeypatch, tmp_path):
    i = ["-i", f"{built}/index"]
    assert cli.main(["query", *i, "x);", "100"], spark) == 0 and capsys.readouterr().out == "TRUE\n"
    (tmp_path / "q").write_bytes(b"100\n")
    assert cli.main(["query", *i, "--file", str(tmp_path / "q")], spark) == 0 and capsys.readouterr().out == "TRUE\n"
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(b"json(x")))
    assert cli.main(["query", *i, "--stdin"], spark) == 0 and capsys.readouterr().out == "FALSE\n"
    assert cli.main(["query", *i, "z" * 17], spark) == 1 and "17 bytes" in capsys.readouterr().err
    for wrong in ([], ["word", "--stdin"]):
        assert cli.main(["query", *i, *wrong], spark) == 1
    assert cli.main(["query", "-i", f"{built}/nothing", "x"], spark) == 1


def test_query_batch(built, spark, capsys, tmp_path):
    (tmp_path / "q").write_bytes(b"base64_decode(\nmissing\r\njson(\n\n" + b"z" * 17 + b"\njson(")
    assert cli.main(["query-batch", "-i", f"{built}/index", "--file", str(tmp_path / "q")], spark) == 1
    out, err = capsys.readouterr()
    assert out == "TRUE\nFALSE\nTRUE\nFALSE\n" and "query line 5 is 17 bytes" in err


def test_usage_is_status_2():
    for argv in ([], ["unknown"], ["build"]):
        with pytest.raises(SystemExit) as e:
            cli.main(argv)
        assert e.value.code == 2
    assert cli.main(["version"]) == 0


def test_progress_lines():
    line = cli.progress_line
    assert line(Progress("shards", "", 2, 5), False, 0) == "shards 2/5"
    assert line(Progress("hash", "hashing", 0, 0, 1536, 2048), False, 61.7) == "hashing 1.5K/2.0K elapsed=61s"
    assert line(Progress("hash", "", 0, 0, 10, 0, "/x"), True, 0) == "hash 10B /x"
    assert line(Progress("plan"), True, 0) == "plan"


def test_config(tmp_path):
    path = tmp_path / "c"
    path.write_text('# all\n\nindex = "/x/i"\n bind=0.0.0.0 \nport = 9090\nrebuild_command = "make all=1"\n')
    config = service.load_config(str(path))
    assert config == service.DaemonConfig("/x/i", "0.0.0.0", 9090, "make all=1")
    assert config.with_flags("/y", None, 1).index_path == "/y" and service.load_config(None).port == 8080
    for bad in ("what = 1", "port = 0", "port = x", "bind =", "no sign"):
        path.write_text("bind = a\n" + bad)
        with pytest.raises(ValueError, match="line 2"):
            service.load_config(str(path))
    for flags in ((None, None, 70000), ("", None, None)):
        with pytest.raises(ValueError):
            config.with_flags(*flags)


def test_responses():
    live = Fake([b"json(", b"a b\xff"], 16)
    ask = lambda *a, runner=None: service.respond(live, runner, *a)
    assert ask("GET", "/health", b"") == (200, "OK\n") and ask("POST", "/health", b"")[0] == 405
    assert ask("GET", "/query?q=json(", b"") == (200, "TRUE\n") and ask("GET", "/query?q=a+b%FF", b"") == (200, "TRUE\n")
    assert ask("POST", "/query", b"json(\n") == (200, "FALSE\n") and ask("PUT", "/query", b"x")[0] == 405
    assert ask("GET", "/query", b"")[0] == 400 and ask("POST", "/query", b"z" * 17)[0] == 413
    assert ask("POST", "/query-batch", b"json(\r\n\nx") == (200, "TRUE\nFALSE\nFALSE\n") and ask("GET", "/query-batch", b"")[0] == 405
    status, text = ask("POST", "/query-batch", b"json(\n" + b"z" * 17)
    assert status == 400 and "line 2" in text
    assert ask("GET", "/rebuild", b"")[0] == ask("GET", "/other", b"")[0] == 404


def test_rebuild():
    runner = service.RebuildRunner("sleep 0.3; exit 3")
    assert runner.status() == "status=idle\n"
    assert service.respond(Fake([]), runner, "POST", "/rebuild", b"")[0] == 202
    assert service.respond(Fake([]), runner, "POST", "/rebuild", b"")[0] == 409
    assert "status=running" in service.respond(Fake([]), runner, "GET", "/rebuild", b"")[1]
    runner.thread.join()
    assert "last_error=exit status 3" in runner.status() and "status=idle" in runner.status()


def test_over_http(built, spark):
    live = service.Live(spark, f"{built}/index")
    server = service.serve(live, service.DaemonConfig(port=0))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert urllib.request.urlopen(base + "/query?q=json(").read() == b"TRUE\n"
        assert urllib.request.urlopen(base + "/query-batch", data=b"json(\nno").read() == b"TRUE\nFALSE\n"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + "/query?q=")
        assert e.value.code == 400
    finally:
        server.shutdown()
    assert live.try_reload()
    live.path = "/nowhere"
    assert not live.try_reload() and live.contains_bytes(b"json(")
