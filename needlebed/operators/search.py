"""Existence of byte strings in a corpus, one or many at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlebed.functions.bytesfn import as_bytes, found_in
from needlebed.shared import work_path

#: Bytes of needles, at most, in one pass over the corpus; more are searched for in several.
NEEDLE_BYTES = 8 << 20
#: The automaton holds this many leading bytes of a needle; the rest is compared where it hits.
LEAD = 24


def contains_one(corpus: DataFrame, needle: bytes, max_bytes: int = 0) -> bool:
    """Whether one needle is in the corpus. The filter stops at the first hit: tasks are started a few at a time."""
    if not needle or (max_bytes and len(needle) > max_bytes):
        return False
    return not corpus.where(found_in(F.col("content"), F.lit(bytearray(needle)))).limit(1).isEmpty()


def _hits(batches, needles: list[bytes]):
    """The needles that are in the contents of a partition, each once; ends early when all are found."""
    short = [n for n in needles if len(n) < 4]
    # By leading bytes, then by length: needles with a long start in common cost one look for each length.
    left: dict[str, dict[int, set[bytes]]] = {}
    for n in needles:
        if len(n) >= 4:
            left.setdefault(n[:LEAD].decode("latin-1"), {}).setdefault(len(n), set()).add(n)
    auto = ahocorasick.Automaton()
    for lead in left:
        auto.add_word(lead, lead)
    if left:
        auto.make_automaton()
    waiting = len(needles)
    for batch in batches:
        found = []
        for cell in batch.column(0):
            body = cell.as_py()
            if body is None or not waiting:
                continue
            now = [n for n in short if n in body]
            if now:
                short = [n for n in short if n not in now]
            for end, lead in auto.iter(body.decode("latin-1")) if left else ():
                if left[lead]:
                    at = end + 1 - len(lead)
                    hit = [(size, n) for size, some in left[lead].items() if (n := body[at : at + size]) in some]
                    for size, n in hit:
                        left[lead][size].discard(n)
                        if not left[lead][size]:
                            del left[lead][size]
                        now.append(n)
            found += now
            waiting -= len(now)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["__needle"])
        if not waiting:
            return


def distinct_needles(queries: DataFrame, needle: str = "needle", max_bytes: int = 0) -> DataFrame:
    """(__needle): the needles to search for, each once; null, empty and over-long ones are nowhere."""
    rows = queries.select(as_bytes(F.col(needle)).alias("__needle")).where("octet_length(__needle) > 0")
    return (rows.where(F.octet_length("__needle") <= max_bytes) if max_bytes else rows).distinct()


def in_passes(distinct: DataFrame, most: int | None = None) -> Iterator[list[bytes]]:
    """The needles in lists of up to about ``most`` bytes, NEEDLE_BYTES by default. More than one list is stored first,
    so that the queries are read once."""
    most = most or NEEDLE_BYTES
    spark = distinct.sparkSession
    passes = -(-(distinct.agg(F.sum(F.octet_length("__needle"))).first()[0] or 0) // most)
    if passes > 1:
        path = work_path(spark, "needles")
        distinct.withColumn("__pass", F.pmod(F.xxhash64("__needle"), F.lit(passes))).repartition("__pass").write.partitionBy("__pass").parquet(path)
        distinct = spark.read.parquet(path)
    for g in range(passes):
        some = distinct.where(F.col("__pass") == g).select("__needle") if passes > 1 else distinct
        yield [bytes(r[0]) for r in some.collect()]


def find(corpus: DataFrame, needles: list[bytes]) -> DataFrame:
    """(__needle): those of some needles that are in the ``content`` of a row of ``corpus``, once for each task that
    finds them. The needles are broadcast."""
    shared = corpus.sparkSession.sparkContext.broadcast(needles)
    return corpus.select("content").mapInArrow(lambda it: _hits(it, shared.value), "__needle binary")


def answered(queries: DataFrame, hits: list[DataFrame], key: str = "line_no", needle: str = "needle") -> DataFrame:
    """(key, found) for each row of ``queries``, whatever its key: is its needle in ``hits``?"""
    if not hits:
        return queries.select(key, F.lit(False).alias("found"))
    asked = queries.select(F.col(key), as_bytes(F.col(needle)).alias("__needle"))
    every = reduce(DataFrame.unionAll, hits).distinct().withColumn("__hit", F.lit(True))
    return asked.join(every, "__needle", "left").select(key, F.coalesce("__hit", F.lit(False)).alias("found"))


def batch_contains(corpus: DataFrame, queries: DataFrame, key: str = "line_no", needle: str = "needle", max_bytes: int = 0) -> DataFrame:
    """(key, found) for each row of ``queries``: is its needle in the ``content`` of a row of ``corpus``?

    The distinct needles are sent to the tasks, up to about NEEDLE_BYTES for one pass over the corpus; in a pass each
    task reads its part once, whatever the number of needles, and returns a needle at most once. Null, empty and over-long
    needles are false without a search. Keys may be of any type, repeat and be null: each row gets its answer.
    """
    return answered(queries, [find(corpus, some) for some in in_passes(distinct_needles(queries, needle, max_bytes))], key, needle)


def as_result(answers: DataFrame, key: str = "line_no") -> DataFrame:
    """(key, result): TRUE or FALSE, as a batch prints them."""
    return answers.select(key, F.when(F.col("found"), "TRUE").otherwise("FALSE").alias("result"))


def missing_needles(corpus: DataFrame, queries: DataFrame, key: str = "line_no", needle: str = "needle", max_bytes: int = 0) -> DataFrame:
    """The keys whose needle is nowhere in the corpus."""
    answers = batch_contains(corpus, queries, key, needle, max_bytes)
    return queries.select(key).distinct().join(answers.where("found").select(key), key, "left_anti")
