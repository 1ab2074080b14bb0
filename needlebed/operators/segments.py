"""Chunks with overlap, and shards of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_sizes(shard_size: int, max_query: int) -> None:
    if shard_size < 1:
        raise ValueError("the shard size must be at least 1 byte")
    if max_query < 1 or max_query >= shard_size:
        raise ValueError("the longest query must have at least 1 byte and fewer than a shard")


def chunk_segments(files: DataFrame, shard_size: int, max_query: int) -> DataFrame:
    """(file_ord, path, seg_ord, offset, length): each file cut into pieces of at most ``shard_size`` bytes that overlap
    by ``max_query`` - 1, so that every string of up to ``max_query`` bytes is whole in one of them."""
    check_sizes(shard_size, max_query)
    size, step = F.col("size"), shard_size - (max_query - 1)
    n = F.when(size <= shard_size, 1).otherwise(F.ceil((size - shard_size) / step) + 1).cast("int")
    rows = files.withColumn("seg_ord", F.explode(F.sequence(F.lit(0), n - 1)))
    offset = F.col("seg_ord").cast("bigint") * step
    return rows.select("file_ord", "path", "seg_ord", offset.alias("offset"), F.least(F.lit(shard_size), size - offset).cast("bigint").alias("length"))


def segment_scan(files: DataFrame, segments: DataFrame | None = None, shard_size: int = 65536, max_query: int = 1024) -> DataFrame:
    """The segments with their ``content``; a piece that hasn't its length is an error. A file's chunks are cut where
    its content is, without a join, unless ``segments`` are given."""
    check_sizes(shard_size, max_query)
    if segments is None:
        body = files.withColumn("__content", F.col("content"))
        size, step = F.col("size"), shard_size - (max_query - 1)
        n = F.when(size <= shard_size, 1).otherwise(F.ceil((size - shard_size) / step) + 1).cast("int")
        rows = body.withColumn("seg_ord", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("offset", F.col("seg_ord").cast("bigint") * step)
        rows = rows.withColumn("length", F.least(F.lit(shard_size), F.col("size") - F.col("offset")).cast("bigint"))
    else:
        rows = segments.join(files.select("file_ord", F.col("content").alias("__content")), "file_ord")
    piece = F.substring("__content", (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    rows = rows.withColumn("content", piece)
    good = F.when(F.octet_length("content") == F.col("length"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("short segment of "), F.col("path"))).cast("binary"))
    return rows.select("file_ord", "path", "seg_ord", "offset", "length", good.alias("content"))


def plan_shards(segments: DataFrame, shard_size: int) -> DataFrame:
    """``segments`` with ``shard_id``: packed in their order, a shard closing when the next segment would overfill it.

    Where a shard ends depends on where the one before it did, so one task goes through the lengths in order; it gets
    nothing but ids and lengths, and leaps from shard to shard by binary search in the running sums, some fifty
    million segments a second.
    """

    def run(batches):
        shard, held, any_yet = 0, 0, False
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype(np.int64)
            sums, out, i = np.cumsum(sizes), np.empty(len(sizes), np.int64), 0
            while i < len(sizes):
                before = sums[i] - sizes[i]
                j = int(np.searchsorted(sums, before + shard_size - held, side="right"))
                if j == i and any_yet:
                    shard, held, any_yet = shard + 1, 0, False
                    continue
                j = max(j, i + 1)
                out[i:j] = shard
                held, any_yet, i = held + int(sums[j - 1] - before), True, j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["file_ord", "seg_ord", "shard_id"])

    ordered = segments.select("file_ord", "seg_ord", "length").repartition(1).sortWithinPartitions("file_ord", "seg_ord")
    plan = ordered.mapInArrow(run, "file_ord bigint, seg_ord int, shard_id bigint")
    return segments.join(plan, ["file_ord", "seg_ord"])


def shard_stats(planned: DataFrame) -> DataFrame:
    """(shard_id, file_count, total_bytes): files counted once a shard, bytes with overlaps."""
    return planned.groupBy("shard_id").agg(F.count_distinct("file_ord").alias("file_count"), F.sum("length").cast("bigint").alias("total_bytes"))


def shard_files(planned: DataFrame) -> DataFrame:
    """(shard_id, files): each shard's paths once, in the order they first come."""
    first = planned.groupBy("shard_id", "path").agg(F.min("file_ord").alias("ord"))
    return first.groupBy("shard_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("files"))


def running_shard_offset(planned: DataFrame) -> DataFrame:
    """``planned`` with ``at``, where a segment starts among its shard's bytes."""
    before = Window.partitionBy("shard_id").orderBy("file_ord", "seg_ord").rowsBetween(Window.unboundedPreceding, -1)
    return planned.withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))
