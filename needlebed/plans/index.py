"""Building an index from files or a table, opening it, and asking it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlebed.errors import EmptyCorpusError, IndexFormatError
from needlebed.functions.sizes import BUILD_FACTOR, DEFAULT_MAX_QUERY, DEFAULT_MEMORY, shard_size_for_memory
from needlebed.operators import bwt, grams, search, segments
from needlebed.plans.manifest import Manifest, Versions, corpus_sha256, read_manifest, write_manifest
from needlebed.shared import by_key
from needlebed.sources.tables import collect_files, read_files

#: Shards and files, at most, that the manifest names; bytes of a shard, about, that one task writes.
LISTED, PIECE = 10_000, 16 << 20


@dataclass
class BuildOptions:
    """``shard_size`` 0: what the memory limit gives. ``single``: one shard, however large, without a limit of needles; one
    task sorts it. ``digest``: the hash of the whole corpus, which one task works out."""

    recursive: bool = False
    memory_limit: int = DEFAULT_MEMORY
    max_query_bytes: int = DEFAULT_MAX_QUERY
    jobs: int = 0
    shard_size: int = 0
    check_every: int = bwt.CHECK_EVERY
    with_bwt: bool = True
    digest: bool = True
    single: bool = False

    def settled(self, spark: SparkSession, total: int = 0) -> BuildOptions:
        if self.memory_limit < BUILD_FACTOR:
            raise ValueError(f"the memory limit must be at least {BUILD_FACTOR} bytes")
        size = max(total, self.max_query_bytes + 1) if self.single else self.shard_size or shard_size_for_memory(self.memory_limit)
        segments.check_sizes(size, self.max_query_bytes)
        jobs = self.jobs or max(1, spark.sparkContext.defaultParallelism)
        return replace(self, jobs=jobs, shard_size=size)


@dataclass
class Progress:
    phase: str
    message: str = ""
    current: int = 0
    total: int = 0
    current_bytes: int = 0
    total_bytes: int = 0
    path: str = ""


def build(spark: SparkSession, paths: list[str], out: str, options: BuildOptions | None = None, progress: Callable[[Progress], None] | None = None) -> Manifest:
    """Index the files at ``paths`` into the folder ``out``."""
    listing = collect_files(spark, paths, (options or BuildOptions()).recursive)
    return build_from(read_files(listing), out, options, progress, list(paths))


def _watched(spark: SparkSession, tell: Callable[[Progress], None], start: Progress, run: Callable[[], None]) -> None:
    """Run Spark jobs and tell how many of their tasks are done, from time to time, and at the end that all is."""
    sc, group, over = spark.sparkContext, f"build-{uuid.uuid4().hex}", threading.Event()

    def watch():
        while not over.wait(0.5):
            tracker, done, every = sc.statusTracker(), 0, 0
            for job in tracker.getJobIdsForGroup(group):
                info = tracker.getJobInfo(job)
                for stage in map(tracker.getStageInfo, info.stageIds if info else []):
                    if stage:
                        done, every = done + stage.numCompletedTasks, every + stage.numTasks
            if every:
                tell(replace(start, message=f"{start.message}, tasks", current=done, total=every))

    tell(start)
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    sc.setJobGroup(group, start.message)
    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        run()
    finally:
        over.set()
        thread.join()
        sc.setLocalProperty("spark.jobGroup.id", before[0])
        sc.setLocalProperty("spark.job.description", before[1])
    tell(replace(start, current=start.total, current_bytes=start.total_bytes))


def build_from(files: DataFrame, out: str, options: BuildOptions | None = None, progress: Callable[[Progress], None] | None = None, input_paths: list[str] | None = None) -> Manifest:
    """Index (file_ord, path, size, content) into ``out``: the segments by shard, filters if there is more than one
    shard, the BWT of each shard if asked for, and the manifest. The source is read once for the plan and once for the
    segments; all else reads the written segments. Shards that don't hold the bytes that were planned are an error."""
    spark, tell = files.sparkSession, progress or (lambda _: None)
    n_files, total, last_path = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint"), F.max("path")).first()
    if not n_files:
        raise EmptyCorpusError("the corpus is empty")
    opt = (options or BuildOptions()).settled(spark, total)
    path = last_path if input_paths else ""
    _watched(spark, tell, Progress("plan", "packing segments into shards", 0, n_files, 0, total, path), lambda: segments.plan_shards(segments.chunk_segments(files, opt.shard_size, opt.max_query_bytes), opt.shard_size).write.parquet(f"{out}/plan"))
    planned = spark.read.parquet(f"{out}/plan")
    held, n_shards = planned.agg(F.sum("length"), F.max("shard_id") + 1).first()
    cut = segments.segment_scan(files, shard_size=opt.shard_size, max_query=opt.max_query_bytes).drop("path")
    placed = cut.join(planned.select("file_ord", "seg_ord", "shard_id"), ["file_ord", "seg_ord"])
    _watched(spark, tell, Progress("segments", "writing segments", 0, n_shards, 0, held, path), lambda: by_key(placed, "shard_id", *_pieces(opt.shard_size)).sortWithinPartitions("shard_id", "file_ord", "seg_ord").write.parquet(f"{out}/segments"))
    stored = spark.read.parquet(f"{out}/segments")
    _check_bytes(planned, stored)
    if n_shards > 1:

        def filters():
            grams.ngram_filter(stored).sortWithinPartitions("bit", "shard_id").write.option("compression", "zstd").parquet(f"{out}/ngram")
            by_key(grams.trigram_index(stored), F.shiftright("gram", 14)).sortWithinPartitions("gram").write.parquet(f"{out}/trigram")

        _watched(spark, tell, Progress("filters", "writing n-gram filter and trigram index", 0, n_shards, 0, held), filters)
    if opt.with_bwt:
        _watched(spark, tell, Progress("shards", "sorting shards", 0, n_shards, 0, held), lambda: bwt.build_index(stored, opt.check_every).write.parquet(f"{out}/bwt"))
    sha = []
    if opt.digest:
        _watched(spark, tell, Progress("hash", "hashing the corpus", 0, n_files, 0, total), lambda: sha.append(corpus_sha256(files, planned.select("file_ord", F.col("length").alias("size")))))
    # The table of the plan has every shard and file; the manifest names them while they are few.
    shards, names = [], []
    if n_shards <= LISTED and n_files <= LISTED:
        stats = segments.shard_stats(planned).join(segments.shard_files(planned), "shard_id").orderBy("shard_id").collect()
        shards = [{"shard_id": r["shard_id"], "file_count": r["file_count"], "total_bytes": r["total_bytes"], "files": r["files"] if input_paths else []} for r in stats]
        names = [r[0] for r in files_of(planned).orderBy("file_ord").select("path").collect()] if input_paths else []
    m = Manifest(n_files, int(total), sha[0] if sha else None, opt.recursive, input_paths or [], opt.memory_limit, opt.max_query_bytes, opt.jobs, opt.shard_size, n_shards, shards, names)
    write_manifest(spark, out, m)
    tell(Progress("done", "index written", n_shards, n_shards, total, total))
    return m


def _pieces(shard_size: int) -> list:
    """What parts the segments of a shard that is larger than a task should write, by their hash; nothing for others."""
    n = -(-shard_size // PIECE)
    return [F.pmod(F.xxhash64("file_ord", "seg_ord"), F.lit(n))] if n > 1 else []


def _check_bytes(planned: DataFrame, stored: DataFrame) -> None:
    """The bytes of each shard are those that were planned."""
    want, got = (df.groupBy("shard_id").agg(F.sum("length").alias(name), F.count("*").alias("n_" + name)) for df, name in ((planned, "want"), (stored, "got")))
    bad = want.join(got, "shard_id", "full").where(~(F.col("want").eqNullSafe(F.col("got")) & F.col("n_want").eqNullSafe(F.col("n_got")))).first()
    if bad:
        raise IndexFormatError(f"shard {bad['shard_id']} holds {bad['got']} bytes in {bad['n_got']} segments, planned were {bad['want']} in {bad['n_want']}")


def files_of(planned: DataFrame) -> DataFrame:
    """(file_ord, path): the indexed files."""
    return planned.groupBy("file_ord").agg(F.first("path").alias("path"))


class Searcher(Protocol):
    def contains(self, needle: str) -> bool: ...

    def contains_bytes(self, needle: bytes) -> bool: ...

    def max_query_bytes(self) -> int: ...


class Index:
    """An index that was built; opening reads its manifest only. A part that can't be read is an error, never a no."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path, read_manifest(spark, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def segments(self) -> DataFrame:
        return self._table("segments")

    def max_query_bytes(self) -> int:
        return self.manifest.query_limit

    def contains(self, needle: str) -> bool:
        return self.contains_bytes(needle.encode())

    def shards(self) -> DataFrame:
        """(shard_id, file_count, total_bytes) of every shard."""
        return segments.shard_stats(self._table("plan"))

    def files(self) -> DataFrame:
        """(file_ord, path) of every indexed file."""
        return files_of(self._table("plan"))

    def contains_bytes(self, needle: bytes) -> bool:
        """One needle: the filter's shards, then the bytes themselves. A needle that may be in more shards than are
        pushed down is searched for in all, which ends at the first hit, and so is one of one or two bytes."""
        limit = self.max_query_bytes()
        if not needle or (limit and len(needle) > limit):
            return False
        rows = self.segments()
        if self.manifest.shard_count > 1 and len(needle) >= grams.TRIGRAM:
            ids = [r[0] for r in self.candidate_shards([needle]).limit(grams.PUSHED + 1).collect()]
            if not ids:
                return False
            if len(ids) <= grams.PUSHED:
                rows = rows.where(F.col("shard_id").isin(ids))
        return search.contains_one(rows, needle, limit)

    def candidate_shards(self, needles: list[bytes]) -> DataFrame:
        """(shard_id): where one of some needles of 3 bytes or more may be; a shard may come more than once."""
        long, middle = [n for n in needles if len(n) >= grams.NGRAM], [n for n in needles if grams.TRIGRAM <= len(n) < grams.NGRAM]
        parts = [grams.filter_shards(self._table("ngram"), long)] if long else []
        if middle:
            asked = self.spark.createDataFrame([(bytearray(n),) for n in middle], "needle binary").withColumn("line_no", F.lit(0))
            index = self._table("trigram")
            grams_ = sorted({int(v) for n in middle for v in grams.trigram_keys(n)})
            if len(grams_) <= grams.PUSHED:
                index = index.where(F.col("gram").isin(grams_))
            parts.append(grams.trigram_candidates(index, asked).select("shard_id"))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], "shard_id bigint")

    def contains_all(self, needles: list[bytes]) -> list[bool]:
        """Answers for a list, in its order, in one pass."""
        if not needles:
            return []
        asked = self.spark.createDataFrame([(i, bytearray(n)) for i, n in enumerate(needles)], "line_no bigint, needle binary")
        return [r["found"] for r in self.batch(asked).orderBy("line_no").collect()]

    def batch(self, queries: DataFrame, key: str = "line_no", needle: str = "needle") -> DataFrame:
        """(key, found) of many needles in one pass over the segments."""
        return search.batch_contains(self.segments(), queries, key, needle, self.max_query_bytes())

    def batch_pruned(self, queries: DataFrame, key: str = "line_no", needle: str = "needle") -> DataFrame:
        """(key, found) by way of the filters: only the segments of shards that some needle may be in are read, each once
        in a pass. Needles of one or two bytes are searched for everywhere."""
        if self.manifest.shard_count == 1:
            return self.batch(queries, key, needle)
        hits = []
        for some in search.in_passes(search.distinct_needles(queries, needle, self.max_query_bytes())):
            short, rest = [n for n in some if len(n) < grams.TRIGRAM], [n for n in some if len(n) >= grams.TRIGRAM]
            if short:
                hits.append(search.find(self.segments(), short))
            if rest:
                hits.append(search.find(grams.in_shards(self.segments(), self.candidate_shards(rest)), rest))
        return search.answered(queries, hits, key, needle)

    def batch_backward(self, queries: DataFrame, key: str = "line_no", needle: str = "needle") -> DataFrame:
        """(key, found) by backward search over the stored transforms."""
        limit, asked = self.max_query_bytes(), F.col(needle).cast("binary")
        if limit:  # a needle that is too long is not searched for
            asked = F.when(F.octet_length(asked) <= limit, asked)
        return bwt.backward_search(self._table("bwt"), queries.select(F.col(key), asked.alias("__asked")), key, "__asked")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark, path)


class Reloadable:
    """The current version of an index. ``reload`` opens what the pointer names now; if that fails, what was open stays."""

    def __init__(self, spark: SparkSession, versions: Versions | str):
        self.spark, self.lock = spark, threading.Lock()
        self.versions = versions if isinstance(versions, Versions) else Versions(versions)
        self.index = Index(spark, self.versions.current())

    def reload(self) -> None:
        new = Index(self.spark, self.versions.current())
        with self.lock:
            self.index = new

    def contains(self, needle: str) -> bool:
        return self.index.contains(needle)

    def contains_bytes(self, needle: bytes) -> bool:
        return self.index.contains_bytes(needle)

    def max_query_bytes(self) -> int:
        return self.index.max_query_bytes()
