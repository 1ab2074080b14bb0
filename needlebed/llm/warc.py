"""WARC files: a normaliser from one gzip stream for the whole file to one gzip member for each record.

A file that was compressed as one stream can only be read from its start. The normaliser inflates that stream once,
finds the records in it, writes each as a member of its own, and writes the members' offsets beside the file; after
that any record can be read by its offset. Files are streamed: no file, and of a record only a buffer, is in memory.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlebed.llm.common import need

CHUNK, LEVEL = 1 << 20, 6
INDEX = "file string, ord bigint, offset bigint, length bigint, record_type string, record_id string, target_uri string, block_bytes bigint, block_sha256 string"
INDEX_FIELDS = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (pafs.LocalFileSystem(), path)


class Replacing:
    """Write a file under another name and rename it at the end, so that a task that ran twice, or died, leaves one
    whole file or none."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        task = TaskContext.get()
        self.part = f"{self.path}.part-{task.taskAttemptId() if task else 0}"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind:
            self.fs.delete_file(self.part)
            return
        if self.fs.get_file_info(self.path).type == pafs.FileType.File:
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)


def record_head(record_id: str, uri: str | None, size: int) -> bytes:
    """The header of a resource record; line ends in the address are percent-encoded."""
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode()


def write_monolithic(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = LEVEL) -> DataFrame:
    """Write one WARC file for each partition of ``pages``, each compressed as a single stream; return (file, records).

    A null page has no record; a null address gives a record without one. An empty partition writes an empty file.
    Repeated rows, and pages of equal ids, are records each. A page's bytes are written as they are, UTF-8 or not; bytes
    of an address that aren't UTF-8 become U+FFFD. A very long page is one record, compressed as it stands in memory.
    Other columns, whatever their names, aren't read. The files are written when the result is first used.
    """
    need(pages, id_col, url_col, html_col)

    def run(batches):
        file, n = f"{out_dir.rstrip('/')}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with Replacing(file) as out:
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            for batch in batches:
                for key, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    body = html.as_py()
                    if body is not None:
                        url = None if url is None else url.decode(errors="replace")
                        for piece in (record_head(f"urn:page:{key}", url, len(body)), body, b"\r\n\r\n"):
                            out.write(z.compress(piece))
                        n += 1
            out.write(z.flush())
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64())], ["file", "records"])

    rows = pages.select(F.col(id_col), F.col(url_col).cast("binary"), F.col(html_col).cast("binary"))
    return rows.mapInArrow(run, "file string, records bigint")


def inflated(stream):
    """The bytes of a file in pieces: of one gzip stream, of several in a row, or as they are. A stream that breaks off
    gives what there is."""
    piece = stream.read(CHUNK)
    if piece[:2] != b"\x1f\x8b":
        while piece:
            yield piece
            piece = stream.read(CHUNK)
        return
    z = zlib.decompressobj(31)
    while piece:
        data = z.decompress(piece, 8 * CHUNK)
        if data:
            yield data
        if z.eof:
            rest = z.unused_data.lstrip(b"\0")
            piece = rest if len(rest) > 1 else rest + stream.read(CHUNK)
            z = zlib.decompressobj(31)
        else:
            piece = z.unconsumed_tail or stream.read(CHUNK)


class Pieces:
    """Reads lines and runs of bytes off an iterator of pieces, by a cursor into the piece that is held."""

    def __init__(self, pieces):
        self.pieces, self.held, self.at = pieces, b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, b"")
        if piece:
            self.held, self.at = self.held[self.at :] + piece if self.at < len(self.held) else piece, 0
        return bool(piece)

    def line(self) -> bytes | None:
        """The next line with its end, of one of more than CHUNK bytes a part; None at the end of the data, a line
        that breaks off included."""
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if seen > CHUNK:
                end = len(self.held) - 1
                break
            if not self.more():
                return None
        line, self.at = self.held[self.at : end + 1], end + 1
        return line

    def run(self, n: int):
        while n:
            if self.at == len(self.held) and not self.more():
                raise EOFError
            piece = self.held[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            yield piece


def parse_head(source: Pieces) -> tuple[bytes, dict[str, str], int] | None:
    """The next record's header, as it stands and by lower-case name, and the bytes of its block; None at the end of
    the data. What doesn't begin with a WARC version, and a header whose Content-Length isn't a number, are passed
    over up to the next line that begins with one."""
    line = source.line()
    while line is not None:
        if not line.startswith(b"WARC/"):
            line = source.line()
            continue
        raw, fields = [line], {}
        while (line := source.line()) is not None and not line.startswith(b"WARC/"):
            raw.append(line)
            if not line.strip():
                break
            name, _, value = line.decode(errors="replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        if line is not None and not line.strip() and re.fullmatch("[0-9]{1,18}", size := fields.get("content-length", "")):
            return b"".join(raw), fields, int(size)
    return None


def normalise_stream(stream, out, file: str, level: int = LEVEL) -> list[dict]:
    """Rewrite one file, a member for each record; return its index.

    A last record that breaks off is left out of the index; what was written of a long one lies unused behind the last
    member. A header without a usable Content-Length, and anything between records that is no header, is passed over.
    """
    source, index, at = Pieces(inflated(stream)), [], 0
    while (head := parse_head(source)) is not None:
        raw, fields, size = head
        sha, z = hashlib.sha256(), zlib.compressobj(level, zlib.DEFLATED, 31)
        member = [z.compress(raw)]
        written = held = 0
        try:
            for piece in source.run(size):
                sha.update(piece)
                member.append(z.compress(piece))
                if (held := held + len(member[-1])) > CHUNK:
                    out.write(b"".join(member))
                    written, held, member = written + sum(map(len, member)), 0, []
        except EOFError:
            break
        member += [z.compress(b"\r\n\r\n"), z.flush()]
        data = b"".join(member)
        out.write(data)
        length = written + len(data)
        uri = fields.get("warc-target-uri")
        index.append(dict(file=file, ord=len(index), offset=at, length=length, record_type=fields.get("warc-type"), record_id=fields.get("warc-record-id", "").strip("<>"), target_uri=uri, block_bytes=size, block_sha256=sha.hexdigest()))
        at += length
    return index


def normalise(files: DataFrame, out_dir: str, file_col: str = "file", level: int = LEVEL) -> DataFrame:
    """Normalise each file named in ``file_col`` into ``out_dir``, with its index beside it in ``<file>.index.parquet``;
    return the index of all, read from there.

    A file is one task's work; null names are left out, names that repeat are one file. Two files of the same base
    name in different folders would meet in ``out_dir``, so that is an error. Executors that are lost only cost their
    task's time: a file appears under its name when it is whole. Files are streamed, records of any length too; empty
    files and damaged headers are as ``normalise_stream`` says. Other columns, whatever their names, aren't read.
    """
    need(files, file_col)
    spark = files.sparkSession
    names = sorted({r[0] for r in files.select(file_col).distinct().collect() if r[0] is not None})
    if len({n.rpartition("/")[2] for n in names}) < len(names):
        raise ValueError("two files have the same base name")
    if not names:
        return spark.createDataFrame([], INDEX)

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                to = f"{out_dir.rstrip('/')}/{file.rpartition('/')[2]}"
                fs, path = filesystem(file)
                with fs.open_input_stream(path, compression=None) as stream, Replacing(to) as out:
                    index = normalise_stream(stream, out, to, level)
                with Replacing(to + ".index.parquet") as out:
                    pq.write_table(pa.Table.from_pylist(index, INDEX_FIELDS), out)
                yield pa.RecordBatch.from_arrays([pa.array([len(index)], pa.int64())], ["records"])

    parts = spark.createDataFrame([(n,) for n in names], "file string").repartitionByRange(len(names), "file")
    parts.mapInArrow(run, "records bigint").agg({"records": "sum"}).collect()
    return read_index(spark, out_dir)


def read_index(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{out_dir.rstrip('/')}/*.index.parquet")


def read_records(index: DataFrame) -> DataFrame:
    """(record_id, target_uri, block) of the records in ``index``, each read by its offset and length alone. Rows of the
    index that repeat are read again; an empty index gives no rows; a record without address has a null one. A block that
    doesn't have its digest is an error. A task holds one record at a time beside the batch that it gives back. Other
    columns of ``index`` aren't read."""

    def run(batches):
        name, stream = None, None
        try:
            for batch in batches:
                got, held = [], 0
                for file, offset, length, want in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "block_sha256"))):
                    if name != file:
                        if stream is not None:
                            stream.close()
                        fs, path = filesystem(file)
                        name, stream = file, fs.open_input_file(path)
                    stream.seek(offset)
                    source = Pieces(inflated(io.BytesIO(stream.read(length))))
                    head = parse_head(source)
                    block = b"".join(source.run(head[2])) if head else None
                    if block is None or hashlib.sha256(block).hexdigest() != want:
                        raise ValueError(f"{file} at {offset}: the block isn't the one that was indexed")
                    got.append((head[1].get("warc-record-id", "").strip("<>"), head[1].get("warc-target-uri"), block))
                    if (held := held + len(block)) > 8 * CHUNK:
                        yield _records(got)
                        got, held = [], 0
                if got:
                    yield _records(got)
        finally:
            if stream is not None:
                stream.close()

    return index.select("file", "offset", "length", "block_sha256").mapInArrow(run, "record_id string, target_uri string, block binary")


def _records(got: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)], ["record_id", "target_uri", "block"])
