"""The layout of a built index: a folder of Parquet tables and a manifest, and versions with a pointer to one."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from needlebed.errors import IndexFormatError

FORMAT, KIND = 2, "needlebed-index"
#: Bytes of content, about, that one task adds to the corpus's digest; the property by which its state goes to the next.
DIGEST_BYTES, STATE = 256 << 20, "needlebed.digest.state"


@dataclass
class Manifest:
    file_count: int
    total_bytes: int
    sha256: str | None
    recursive: bool
    input_paths: list[str]
    memory_limit: int
    max_query_bytes: int
    jobs: int
    shard_size: int
    shard_count: int
    shards: list[dict] = field(default_factory=list)
    indexed_files: list[str] = field(default_factory=list)
    version: int = FORMAT
    kind: str = KIND
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    @property
    def query_limit(self) -> int:
        """What a needle may have at most; 0, no limit, for an index of one shard, where nothing was cut."""
        return self.max_query_bytes if self.shard_count > 1 else 0


def write_manifest(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Written last, so that a folder with a manifest is a whole index."""
    spark.createDataFrame([(json.dumps(asdict(manifest)),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    from pyspark.errors import AnalysisException

    try:
        text = "\n".join(r[0] for r in spark.read.text(f"{path}/manifest").collect())
        got = json.loads(text)
    except (AnalysisException, ValueError) as e:
        raise IndexFormatError(f"{path} is no index: {e}") from e
    if got.get("kind") != KIND or got.get("version") != FORMAT:
        raise IndexFormatError(f"{path}: kind {got.get('kind')}, version {got.get('version')} can't be read")
    if got["shard_count"] < 1:
        raise IndexFormatError(f"{path} has no shards")
    return Manifest(**got)


def manifest_frame(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """One row with the manifest's totals."""
    m = manifest
    return spark.createDataFrame([(m.file_count, m.total_bytes, m.sha256, m.shard_count, m.shard_size, m.max_query_bytes)], "file_count bigint, total_bytes bigint, sha256 string, shard_count bigint, shard_size bigint, max_query_bytes bigint")


def file_sha256(files: DataFrame) -> DataFrame:
    return files.select("file_ord", F.sha2("content", 256).alias("sha256"))


def _libcrypto():
    """OpenSSL's library, which Python's own hashes are from, or None if it hasn't the calls with an open state."""
    import ctypes
    import ctypes.util

    try:
        import _hashlib

        names = [_hashlib.__file__]
    except (ImportError, AttributeError):
        names = []
    for name in [*names, ctypes.util.find_library("crypto")]:
        try:
            lib = ctypes.CDLL(name) if name else None
            if lib is not None and all(hasattr(lib, f"SHA256_{f}") for f in ("Init", "Update", "Final")):
                lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
                return lib
        except OSError:
            pass
    return None


class Sha256:
    """SHA-256 whose state is 112 bytes, the context of OpenSSL, that another process can go on with."""

    def __init__(self, state: bytes = b""):
        import ctypes

        self.lib, self.context = _libcrypto(), ctypes.create_string_buffer(state or 112, 112)
        if not state:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, len(data))

    def state(self) -> bytes:
        return self.context.raw

    def digest(self) -> bytes:
        import ctypes

        out, end = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state(), 112)
        self.lib.SHA256_Final(out, end)
        return out.raw


def _range_of(order, bounds: list[int], first: int = 0):
    """The number of the range that an order is in, by halving; ``bounds`` are where all ranges but the first begin."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(order < bounds[half], _range_of(order, bounds[:half], first)).otherwise(_range_of(order, bounds[half + 1 :], first + half + 1))


def digest_bounds(sizes: DataFrame, most: int) -> list[int]:
    """Where the ranges of the order begin, but the first, so that each has up to ``most`` bytes and what one order has.
    One task goes through the orders and lengths."""
    upto = F.sum("size").over(Window.orderBy(F.col("file_ord").asc_nulls_last()))
    ranges = sizes.select("file_ord", F.floor((upto - 1) / most).alias("r")).where("file_ord IS NOT NULL").groupBy("r").agg(F.min("file_ord").alias("at"))
    return sorted(r["at"] for r in ranges.collect())[1:]


def corpus_sha256(files: DataFrame, sizes: DataFrame | None = None, most: int | None = None) -> str:
    """SHA-256 of all contents one after another, in order, with nothing between. The state of the hash goes from
    content to content, so contents are read one after the other, but not by one task: each range of the order, of about
    ``most`` bytes (DIGEST_BYTES), is a task of its own, which goes on with the state that the one before it ended with.
    ``sizes`` (file_ord, size) spare a reading of the contents for their lengths."""
    import pyarrow as pa
    from pyspark import TaskContext

    spark = files.sparkSession
    bounds = digest_bounds(files.select("file_ord", "size") if sizes is None else sizes, most or DIGEST_BYTES) if _libcrypto() else []
    ranged = files.select(_range_of(F.col("file_ord"), bounds).alias("range"), "file_ord", "path", "content")
    ordered = ranged.repartitionById(len(bounds) + 1, F.col("range")) if bounds else ranged.repartition(1)
    ordered = ordered.sortWithinPartitions(F.col("file_ord").asc_nulls_last(), "path").select("content")
    if not bounds:
        return ordered.mapInArrow(_digest, "sha256 string").first()[0]

    def run(batches):
        h = Sha256(bytes.fromhex(TaskContext.get().getLocalProperty(STATE) or ""))
        for batch in batches:
            for body in batch.column(0):
                h.update(body.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([h.state()], pa.binary())], ["state"])

    sc, tasks, state = spark.sparkContext, ordered.mapInArrow(run, "state binary").rdd, b""
    try:
        for i in range(len(bounds) + 1):
            sc.setLocalProperty(STATE, state.hex())
            state = bytes(sc.runJob(tasks, list, [i])[0]["state"])
    finally:
        sc.setLocalProperty(STATE, None)
    return Sha256(state).digest().hex()


def _digest(batches):
    """The digest of all that one task reads."""
    import hashlib

    import pyarrow as pa

    h = hashlib.sha256()
    for batch in batches:
        for body in batch.column(0):
            h.update(body.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], ["sha256"])


class Versions:
    """Immutable indexes below one folder and a pointer to the current one, swapped in one rename. Local or mounted
    paths only: renaming over a file is what makes the swap whole."""

    def __init__(self, root: str):
        self.root = root

    def new_path(self) -> str:
        return os.path.join(self.root, "v-" + uuid.uuid4().hex)

    def current(self) -> str:
        try:
            with open(os.path.join(self.root, "CURRENT")) as f:
                return os.path.join(self.root, f.read().strip())
        except FileNotFoundError:
            raise IndexFormatError(f"{self.root} has no current version") from None

    def publish(self, path: str) -> None:
        part = os.path.join(self.root, "CURRENT." + uuid.uuid4().hex)
        with open(part, "w") as f:
            f.write(os.path.basename(path))
        os.replace(part, os.path.join(self.root, "CURRENT"))
