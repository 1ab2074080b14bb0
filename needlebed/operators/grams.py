"""Postings of trigrams and Bloom bits of 8-grams by shard, and the shards that a needle may be in.

Grams of whole columns are taken in numpy; what they give is joined and counted by Spark. Neither filter ever loses a
shard that holds the needle.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlebed.functions.bytesfn import _A0, _C48, _FNV, _G, BLOOM_BITS, as_bytes
from needlebed.operators.search import batch_contains, distinct_needles, in_passes
from needlebed.shared import by_key, shared_dir

TRIGRAM, NGRAM, BLOCK = 3, 8, 1 << 15
#: Bits of a filter that are packed together; bits of a needle that are enough; ids that are pushed down, and broadcast.
GROUP, PROBE, PUSHED, BROADCAST_IDS = 1 << 21, 24, 1000, 1 << 20
#: Values of a needle that are looked up before all of them are; values that a task holds, those that repeat with them.
FIRST, HELD = 8, 1 << 21


def trigram_keys(body: bytes) -> np.ndarray:
    """The trigrams of some bytes, in order, as big-endian numbers."""
    x = np.frombuffer(body, np.uint8).astype(np.int64)
    return (x[:-2] << 16) | (x[1:-1] << 8) | x[2:] if len(x) >= TRIGRAM else np.empty(0, np.int64)


def bloom_values(body: bytes) -> np.ndarray:
    """Both Bloom bits of every 8-gram of some bytes, the first of all and then the second of all. Masks are left to the
    end, since what is masked never comes down to the low 25 bits in eight steps, and blocks stay in a core's cache."""
    x = np.frombuffer(body, np.uint8)
    m = len(x) - NGRAM + 1
    if m < 1:
        return np.empty(0, np.uint32)
    out, size = np.empty((2, m), np.uint32), min(m, BLOCK)
    c_, t_, u_ = (np.empty(size, np.uint64) for _ in range(3))
    for at in range(0, m, BLOCK):
        n = min(BLOCK, m - at)
        here, a, c, t, u = x[at : at + n + NGRAM - 1].astype(np.uint32), out[0, at : at + n], c_[:n], t_[:n], u_[:n]
        add = here.astype(np.uint64)
        add += np.uint64(_G)
        a[:], c[:] = _A0, _G
        for i in range(NGRAM):
            a ^= here[i : i + n]
            a *= np.uint32(_FNV)
            np.left_shift(c, np.uint64(6), out=t)
            np.right_shift(c, np.uint64(2), out=u)
            t += u
            t += add[i : i + n]
            c ^= t
        c |= np.uint64(1)
        c += a
        out[1, at : at + n] = c & np.uint64(BLOOM_BITS - 1)
        a &= np.uint32(BLOOM_BITS - 1)
    return out.ravel()


def bloom_pairs(body: bytes) -> np.ndarray:
    """Both Bloom bits of every 8-gram of some bytes: shape (windows, 2)."""
    return bloom_values(body).reshape(2, -1).T.astype(np.int64)


def distinct(v: np.ndarray) -> np.ndarray:
    """Numbers in order, each once."""
    v = np.sort(v)
    return v[np.r_[True, v[1:] != v[:-1]]] if len(v) else v


def _distinct_by(df: DataFrame, key: str, content: str, what, rows, schema: str) -> DataFrame:
    """What ``rows`` makes of a key and the distinct, sorted values that ``what`` finds in its contents. The contents are
    brought together by key, which moves a fraction of what their values would; no shuffle follows."""

    def run(batches):
        held: list[np.ndarray] = []
        at, n, most = None, 0, HELD
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != at:
                    if held:
                        yield rows(at, distinct(np.concatenate(held)).astype(np.int64))
                    at, held, n, most = k, [], 0, HELD
                held.append(what(body.as_py()))
                n += len(held[-1])
                if n > most:
                    held = [distinct(np.concatenate(held))]
                    n, most = len(held[0]), max(HELD, 2 * len(held[0]))
        if held:
            yield rows(at, distinct(np.concatenate(held)).astype(np.int64))

    some = df.select(F.col(key).cast("bigint").alias(key), as_bytes(F.col(content)).alias("__body")).where(F.col(key).isNotNull() & F.col("__body").isNotNull())
    return by_key(some, key).sortWithinPartitions(key).mapInArrow(run, schema)


def _pairs_of(key: str, name: str):
    return lambda at, v: pa.RecordBatch.from_arrays([pa.array(np.full(len(v), at, np.int64)), pa.array(v)], [key, name])


def trigram_index(segments: DataFrame, key: str = "shard_id", content: str = "content") -> DataFrame:
    """(shard_id, gram): the trigrams of each shard, each once."""
    return _distinct_by(segments, key, content, trigram_keys, _pairs_of(key, "gram"), f"{key} bigint, gram bigint")


def pack(bits: np.ndarray) -> bytes:
    """Sorted numbers below GROUP: as a bitmap, or where that is shorter as their differences."""
    if 4 * len(bits) < GROUP // 8:
        return np.diff(bits, prepend=0).astype("<u4").tobytes()
    full = np.zeros(GROUP, bool)
    full[bits] = True
    return np.packbits(full).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) < GROUP // 8:
        return np.cumsum(np.frombuffer(data, "<u4").astype(np.int64))
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def has(data: bytes, wanted: np.ndarray) -> np.ndarray:
    """Which of some numbers are in a packed set."""
    if len(data) < GROUP // 8:
        some = unpack(data)
        return some[np.minimum(np.searchsorted(some, wanted), len(some) - 1)] == wanted if len(some) else np.zeros(len(wanted), bool)
    return (np.frombuffer(data, np.uint8)[wanted >> 3] >> (7 - (wanted & 7))) & 1 > 0


def _packed(v: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(first, how many, packed) of each group that some sorted bits are in."""
    ends = np.searchsorted(v, np.arange(0, BLOOM_BITS + GROUP, GROUP))
    return [(g * GROUP, int(b - a), pack(v[a:b] - g * GROUP)) for g, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]


def ngram_filter(segments: DataFrame, key: str = "shard_id", content: str = "content") -> DataFrame:
    """(shard_id, bit, n_bits, bits): the Bloom bits that the 8-grams of each shard set, packed by groups of GROUP bits;
    ``bit`` is a group's first."""

    def rows(at, v):
        sets = _packed(v)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(sets), at, np.int64)), *(pa.array([x[i] for x in sets], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary())))], [key, "bit", "n_bits", "bits"])

    return _distinct_by(segments, key, content, bloom_values, rows, f"{key} bigint, bit bigint, n_bits bigint, bits binary")


def unpacked(filters: DataFrame) -> DataFrame:
    """(shard_id, bit): a packed filter's bits, each a row."""

    def run(batches):
        for batch in batches:
            for shard, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                v = unpack(data.as_py()) + first
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), shard, np.int64)), pa.array(v)], ["shard_id", "bit"])

    return filters.select("shard_id", "bit", "bits").mapInArrow(run, "shard_id bigint, bit bigint")


def ngram_filter_bits(segments: DataFrame, key: str = "shard_id", content: str = "content") -> DataFrame:
    """(shard_id, bit): the Bloom bits that the 8-grams of each shard set, each once."""
    return _distinct_by(segments, key, content, bloom_values, _pairs_of(key, "bit"), f"{key} bigint, bit bigint")


def wanted_bits(needles: list[bytes], least: int = PROBE) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By the first bit of a group: the numbers of needles, how many groups each of them goes through, where each one's
    bits begin, and the bits. A needle goes through the groups that have most of its bits, until it has ``least``: a part
    of the bits is a weaker filter, but never loses a shard."""
    by_group: dict[int, list] = {}
    for i, needle in enumerate(needles):
        v = distinct(bloom_values(needle)).astype(np.int64)
        groups, first, n = np.unique(v // GROUP, return_index=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        some = order[: int(np.searchsorted(np.cumsum(n[order]), least)) + 1]
        for g in some:
            by_group.setdefault(int(groups[g]) * GROUP, []).append((i, len(some), v[first[g] : first[g] + n[g]] % GROUP))
    out = {}
    for g, rows in by_group.items():
        sizes = [len(r[2]) for r in rows]
        out[g] = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.r_[0, np.cumsum(sizes[:-1])].astype(np.int64), np.concatenate([r[2] for r in rows])
    return out


def filter_shards(filters: DataFrame, needles: list[bytes]) -> DataFrame:
    """(shard_id): the shards that one of some needles of 8 bytes or more may be in, once for each such needle. The needles'
    bits are broadcast, and of the stored filter only their groups are read, by a filter that is pushed down."""
    wanted = wanted_bits(needles)
    shared = filters.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for shard, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                number, need, starts, bits = shared.value[first]
                hit = np.flatnonzero(np.logical_and.reduceat(has(data.as_py(), bits), starts))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), shard, np.int64)), pa.array(number[hit]), pa.array(need[hit])], ["shard_id", "number", "need"])

    rows = filters.where(F.col("bit").isin(sorted(wanted))).select("shard_id", "bit", "bits")
    had = rows.mapInArrow(run, "shard_id bigint, number bigint, need bigint")
    if all((need == 1).all() for _, need, _, _ in wanted.values()):
        return had.select("shard_id")
    return had.groupBy("shard_id", "number", "need").agg(F.count("*").alias("had")).where("had = need").select("shard_id")


def bit_totals(segments: DataFrame, key: str = "shard_id", content: str = "content") -> DataFrame:
    """(shard_id, n_bits_set, bit_sum): how many bits ``ngram_filter`` packs for each shard, and their sum. Each bit is
    packed, unpacked and counted in the task that finds it; one row of a shard goes on."""

    def rows(at, v):
        sets = [unpack(data) + first for first, _, data in _packed(v)]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sum(map(len, sets))], pa.int64()), pa.array([sum(int(x.sum()) for x in sets)], pa.int64())], [key, "n_bits_set", "bit_sum"])

    return _distinct_by(segments, key, content, bloom_values, rows, f"{key} bigint, n_bits_set bigint, bit_sum bigint").where("n_bits_set > 0")


def _which(some: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the numbers asked for are among some; both are in order and distinct, the fewer are looked up."""
    if not len(some) or not len(asked):
        return np.zeros(len(asked), bool)
    if len(asked) <= len(some):
        return some[np.minimum(np.searchsorted(some, asked), len(some) - 1)] == asked
    at, out = np.minimum(np.searchsorted(asked, some), len(asked) - 1), np.zeros(len(asked), bool)
    out[at[asked[at] == some]] = True
    return out


class Wanted:
    """The values of some needles: a few of each, from all over it, and all of them, unless ``least`` are enough."""

    def __init__(self, needles: list[bytes], what, least: int | None = None):
        sets = [distinct(what(n)).astype(np.int64) for n in needles]
        width = min(least or FIRST, max(map(len, sets)))
        few = np.array([v[np.arange(width) * len(v) // width] for v in sets])
        self.few, self.places = np.unique(few, return_inverse=True)
        self.places, self.every = self.places.reshape(few.shape), sets if least is None else None

    def among(self, values: np.ndarray) -> np.ndarray:
        """The numbers of the needles whose values are all among some."""
        hit = np.flatnonzero(_which(values, self.few)[self.places].all(1))
        return hit if self.every is None else np.array([i for i in hit if _which(values, self.every[i]).all()], np.int64)


def probe(segments: DataFrame, needles: list[bytes], what, least: int | None = None, key: str = "shard_id", content: str = "content") -> DataFrame:
    """(nid, shard_id): the shards that have all values of one of some needles, or ``least`` of them, which is a weaker
    filter but never loses a shard; a needle has one value at least. The needles go to the tasks, which look them up in
    the values of a shard, so that no rows are made of these."""
    shared = segments.sparkSession.sparkContext.broadcast((Wanted(needles, what, least), [hashlib.md5(n).digest() for n in needles]))

    def rows(at, v):
        wanted, nids = shared.value
        hit = wanted.among(v)
        return pa.RecordBatch.from_arrays([pa.array([nids[i] for i in hit], pa.binary()), pa.array(np.full(len(hit), at, np.int64))], ["nid", key])

    return _distinct_by(segments, key, content, what, rows, f"nid binary, {key} bigint")


def _probed(segments: DataFrame, queries: DataFrame, key: str, needle: str, what, least: int) -> DataFrame:
    """(key, shard_id) as ``_divided`` gives it, of segments; needles of fewer than ``least`` bytes have no values."""
    asked = distinct_needles(queries, needle).where(F.octet_length("__needle") >= least)
    had = [probe(segments, some, what) for some in in_passes(asked) if some]
    rows = queries.select(F.col(key), _needle_id(as_bytes(F.col(needle))).alias("nid"))
    return rows.join(reduce(DataFrame.unionAll, had), "nid").select(key, "shard_id") if had else rows.select(key, F.lit(0).cast("bigint").alias("shard_id")).where("false")


def ngram_shards(segments: DataFrame, queries: DataFrame, key: str = "line_no", needle: str = "needle") -> DataFrame:
    """``ngram_candidates`` of segments whose filter isn't stored, for each row of ``queries``."""
    return _probed(segments, queries, key, needle, bloom_values, NGRAM)


def trigram_shards(segments: DataFrame, queries: DataFrame, key: str = "line_no", needle: str = "needle") -> DataFrame:
    """``trigram_candidates`` of segments whose index isn't stored, for each row of ``queries``."""
    return _probed(segments, queries, key, needle, trigram_keys, TRIGRAM)


def _needle_id(c):
    return F.unhex(F.md5(c))


def _divided(index: DataFrame, value: str, queries: DataFrame, key: str, needle: str, what) -> DataFrame:
    """(key, shard_id): the shards that have all the values of a query's needle (relational division), for each row of
    ``queries``. Needles are told apart by their content, so keys may be of any type, repeat and be null. Rows whose
    needle has no values have no shards."""

    def run(batches):
        for batch in batches:
            for nid, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = distinct(what(body.as_py())).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([nid] * len(v), pa.binary()), pa.array(v), pa.array(np.full(len(v), len(v)))], ["nid", value, "wanted"])

    wanted = distinct_needles(queries, needle).select(_needle_id("__needle").alias("nid"), "__needle").mapInArrow(run, f"nid binary, {value} bigint, wanted bigint")
    had = wanted.join(index, value).groupBy("nid", "wanted", "shard_id").agg(F.count("*").alias("had")).where("had = wanted")
    return queries.select(F.col(key), _needle_id(as_bytes(F.col(needle))).alias("nid")).join(had, "nid").select(key, "shard_id")


def trigram_candidates(index: DataFrame, queries: DataFrame, key: str = "line_no", needle: str = "needle") -> DataFrame:
    """(key, shard_id): shards that have every trigram of the needle."""
    return _divided(index, "gram", queries, key, needle, trigram_keys)


def ngram_candidates(index: DataFrame, queries: DataFrame, key: str = "line_no", needle: str = "needle") -> DataFrame:
    """(key, shard_id): shards whose filter has both bits of every 8-gram of the needle."""
    return _divided(index, "bit", queries, key, needle, bloom_values)


def route(needle):
    """Which filter a needle goes through: the 8-gram filter in place of trigrams, none for one and two bytes."""
    n = F.octet_length(as_bytes(needle))
    return F.when(n >= NGRAM, "ngram").when(n >= TRIGRAM, "trigram").when(n > 0, "scan").otherwise("empty")


def candidates(shards: DataFrame, trigrams: DataFrame, bits: DataFrame, queries: DataFrame, key: str = "line_no", needle: str = "needle") -> DataFrame:
    """(key, shard_id): where each needle may be, by its route. Needles of one or two bytes may be anywhere: a row for
    each of them and each shard, so they are better searched for without this."""
    routed = queries.withColumn("__route", route(F.col(needle)))
    long, middle, short = (routed.where(F.col("__route") == r) for r in ("ngram", "trigram", "scan"))
    every = short.select(F.col(key)).crossJoin(shards.select("shard_id").distinct())
    return ngram_candidates(bits, long, key, needle).unionByName(trigram_candidates(trigrams, middle, key, needle)).unionByName(every)


def in_shards(segments: DataFrame, shards: DataFrame) -> DataFrame:
    """The segments of some shards (shard_id): few are pushed down to the scan by their ids, more are a semi-join, whose
    smaller side is broadcast if it is measured to be small."""
    shared_dir(segments.sparkSession)
    some = shards.distinct().checkpoint()
    n = some.count()
    if n <= PUSHED:
        return segments.where(F.col("shard_id").isin(sorted(r[0] for r in some.collect())))
    return segments.join(F.broadcast(some) if n <= BROADCAST_IDS else some, "shard_id", "left_semi")


def verify(segments: DataFrame, pairs: DataFrame, queries: DataFrame, key: str = "line_no", needle: str = "needle") -> DataFrame:
    """(key): the queries whose needle is in a segment of a candidate shard; a key that several rows have, if one of
    them is found. Each segment is read once, whatever the number of needles that its shard is a candidate for."""
    return batch_contains(in_shards(segments, pairs.select("shard_id")), queries, key, needle).where("found").select(key).distinct()
