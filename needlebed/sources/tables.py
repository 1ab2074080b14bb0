"""Corpora from tables and files: one row for each document, so that nothing matches across two of them."""

from __future__ import annotations

import os
import stat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needlebed.errors import EmptyCorpusError
from needlebed.functions.bytesfn import as_bytes, trim_line_end

LISTING = "file_ord bigint, path string, size bigint"


def from_table(df: DataFrame, id_col: str, content: str | Column) -> DataFrame:
    """(file_ord, path, size, content) of a table; the id is the order, rows with null content are left out."""
    body = as_bytes(F.col(content) if isinstance(content, str) else content)
    out = df.select(F.col(id_col).cast("bigint").alias("file_ord"), F.col(id_col).cast("string").alias("path"), body.alias("content")).where("content IS NOT NULL")
    return out.select("file_ord", "path", F.octet_length("content").cast("bigint").alias("size"), "content")


def _regular(entry: os.DirEntry) -> bool:
    return entry.is_file(follow_symlinks=False)


def list_files(paths: list[str], recursive: bool = False) -> list[tuple[str, int]]:
    """(path, size) of the regular files that are named or in the folders named, sorted by the paths' bytes.

    Hidden and empty files count, a file named twice counts twice. A link that is named is followed; links within a
    folder are not. Without ``recursive`` a folder gives its own files only.
    """
    if not paths:
        raise ValueError("no input paths")
    found: list[tuple[str, int]] = []

    def folder(path: str) -> None:
        with os.scandir(path) as entries:
            for e in entries:
                if _regular(e):
                    found.append((os.path.join(path, e.name), e.stat(follow_symlinks=False).st_size))
                elif recursive and e.is_dir(follow_symlinks=False):
                    folder(e.path)

    for path in paths:
        info = os.stat(path)
        if stat.S_ISDIR(info.st_mode):
            folder(os.path.normpath(path))
        elif stat.S_ISREG(info.st_mode):
            found.append((os.path.normpath(path), info.st_size))
    if not found:
        raise EmptyCorpusError("no regular files in the input")
    return sorted(found, key=lambda f: os.fsencode(f[0]))


def collect_files(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """(file_ord, path, size): the listing as a table."""
    rows = [(i, p, n) for i, (p, n) in enumerate(list_files(paths, recursive))]
    return spark.createDataFrame(rows, LISTING)


def read_files(listing: DataFrame) -> DataFrame:
    """The listing with ``content``, read by the tasks. A file whose length is no longer that of the listing is an
    error. Spark's own binary source leaves out hidden and empty files, so it isn't used."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                with open(row.column(1)[0].as_py(), "rb") as f:
                    data = f.read()
                if len(data) != row.column(2)[0].as_py():
                    raise ValueError(f"{row.column(1)[0].as_py()} changed while it was read")
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], ["file_ord", "path", "size", "content"])

    return listing.select("file_ord", "path", "size").mapInArrow(run, LISTING + ", content binary")


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, needle): a text's lines as queries, numbered from 1. A line ends at a line feed; a carriage return
    before it goes too. Nothing follows the last line feed; empty lines in between stay."""
    parts = F.split(F.col(text_col), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = df.select(F.col(id_col), F.posexplode(parts).alias("pos", "line"))
    return rows.select(id_col, (F.col("pos") + 1).cast("bigint").alias("line_no"), trim_line_end(F.col("line")).alias("needle"))


def split_lines(data: bytes) -> list[bytes]:
    """The queries of a batch file's bytes, by the rules of ``lines_of``."""
    lines = data.split(b"\n")
    return [x[:-1] if x.endswith(b"\r") else x for x in (lines[:-1] if not lines[-1] else lines)]


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, needle) of a batch file. Bytes that aren't UTF-8 stay as they are."""
    with open(path, "rb") as f:
        rows = list(enumerate(split_lines(f.read()), 1))
    return spark.createDataFrame([(n, bytearray(x)) for n, x in rows], "line_no bigint, needle binary")
