"""Suffix arrays, Burrows-Wheeler transforms with rank checkpoints, and backward search, shard by shard.

A shard is sorted within one task, in numpy; shards are as large as a task's memory allows and as many as there are.
Symbols: a byte b is b + 1, the end of the text 0, the mark between two segments 257, so that a mark sorts above every
byte and no match runs over it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needlebed.functions.bytesfn import as_bytes
from needlebed.operators.search import answered, distinct_needles, in_passes
from needlebed.shared import by_key, shared_dir

END, MARK, SYMBOLS, CHECK_EVERY = 0, 257, 258, 4096
#: Rows of a shard for each needle from which checkpoints are quicker than sorting all rows.
ROWS_A_NEEDLE = 5000
#: ``bwt`` has a byte for each row; ``marks`` are the rows of the end and of the marks, whose bytes are 0 and mean nothing.
INDEX = "shard_id bigint, length bigint, c array<bigint>, bwt binary, end_row bigint, marks binary, check_every int, checks binary"


def symbols(parts: list[bytes]) -> np.ndarray:
    """One text of several segments, with marks between them and the end behind."""
    out = []
    for i, p in enumerate(parts):
        if i:
            out.append(np.array([MARK], np.int64))
        out.append(np.frombuffer(p, np.uint8).astype(np.int64) + 1)
    return np.concatenate([*out, np.array([END], np.int64)])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order. Seven symbols are sorted at once; then only suffixes that are still tied are
    sorted again, by the rank of what follows, twice as far on each time. A text that repeats itself, so that many are
    tied after that, is sorted by ``skew`` over the ranks."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key <<= 9
        key[: max(0, n - i)] |= text[i:]
    order = np.argsort(key)
    first = np.r_[True, key[order][1:] != key[order][:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    ahead = 7
    while True:
        last = np.r_[first[1:], True]
        tied = np.flatnonzero(~(first & last))
        if not len(tied):
            return order
        if ahead > 7 and len(tied) > n // 4 and n > 4096:
            return skew(rank)
        at = order[tied]
        after = np.where(at + ahead < n, rank[np.minimum(at + ahead, n - 1)], -1)
        again = np.argsort(rank[at] * (n + 1) + after)
        group, after, at = rank[at][again], after[again], at[again]
        order[tied] = at
        first[tied] = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank[at] = np.maximum.accumulate(np.where(first[tied], tied, 0))
        ahead *= 2


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """An order of keys, their ranks from 1 on, equal keys being of one rank, and the last rank."""
    order = np.argsort(keys)
    some, out = keys[order], np.empty(len(keys), np.int64)
    ranks = np.cumsum(np.r_[True, some[1:] != some[:-1]])
    out[order] = ranks
    return order, out, int(ranks[-1])


def skew(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of some numbers (not below 0, under 2^31) in order: those at places that 3 doesn't divide
    as a text of triples, the others from these (Kärkkäinen and Sanders, 2003), in sorts of a few times their number."""
    n = len(s)
    if n < 64:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    most = int(s.max()) + 2
    pad = np.r_[s + 1, 0, 0, 0]
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.r_[one, two]
    pair = pad[:-1] * most + pad[1:]
    if most**3 >= 1 << 62:
        pair = _dense(pair)[1]
    order, name, last = _dense(pair[sample] * most + pad[sample + 2])
    if last < len(sample):
        order = skew(name)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    by_sample = sample[order]
    by_sample = by_sample[by_sample < n]
    zero, wide = np.arange(0, n, 3), n + 2
    key = pad[zero] * wide + rank[zero + 1]
    sort = np.argsort(key)
    zero, key = zero[sort], key[sort]
    # How many of the sample come before each of the others: those at 1 and at 2 modulo 3 are in order among themselves.
    is_one = by_sample % 3 == 1
    ones, twos = by_sample[is_one], by_sample[~is_one]
    before = np.searchsorted(pad[ones] * wide + rank[ones + 1], key)
    if most * most * wide >= 1 << 62 and most**3 < 1 << 62:
        pair = _dense(pair)[1]
    before += np.searchsorted(pair[twos] * wide + rank[twos + 2], pair[zero] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zero, by_sample
    return out


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BWT and the table C: how many symbols are smaller, for each symbol and one beyond."""
    order = suffix_array(text)
    counts = np.bincount(text, minlength=SYMBOLS)
    return text[order - 1].astype(np.uint16), np.r_[0, np.cumsum(counts)]


def checkpoints(bwt: np.ndarray, every: int = CHECK_EVERY) -> np.ndarray:
    """How often each symbol comes before rows 0, every, 2 * every, ..., with one row behind the last."""
    blocks = len(bwt) // every + 1
    flat = np.bincount((np.arange(len(bwt)) // every + 1) * SYMBOLS + bwt, minlength=(blocks + 1) * SYMBOLS).reshape(-1, SYMBOLS)
    return narrow(flat.cumsum(0)[:blocks])


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as 32-bit numbers; one that doesn't fit is an error."""
    if counts.size and int(counts.max()) > 0xFFFFFFFF:
        raise OverflowError(f"a count of {int(counts.max())} doesn't fit a checkpoint of 32 bits")
    return counts.astype(np.uint32)


def occ(bwt: np.ndarray, checks: np.ndarray, every: int, symbol: int, upto: int) -> int:
    """How often a symbol comes in the first ``upto`` rows."""
    block = upto // every
    return int(checks[block, symbol]) + int(np.count_nonzero(bwt[block * every : upto] == symbol))


def search(needle: bytes, c, bwt: np.ndarray, checks: np.ndarray, every: int) -> bool:
    """Backward search: the rows whose suffixes start with ever more of the needle, from its end."""
    if not needle:
        return False
    left, right = 0, len(bwt)
    for b in reversed(needle):
        left, right = (int(c[b + 1]) + occ(bwt, checks, every, b + 1, x) for x in (left, right))
        if left >= right:
            return False
    return True


def search_many(needles: list[bytes], bwt: np.ndarray) -> np.ndarray:
    """Backward search of many needles in step. With the rows sorted by symbol, then row, C and the rank together are
    one binary search."""
    n = len(bwt)
    rows = np.argsort(bwt, kind="stable")
    keys = bwt[rows].astype(np.int64) * n + rows
    size = np.array([len(x) for x in needles])
    left, right, alive = np.zeros(len(needles), np.int64), np.full(len(needles), n), np.flatnonzero(size > 0)
    ends = np.cumsum(size)
    flat = np.frombuffer(b"".join(needles), np.uint8).astype(np.int64) + 1
    done, t = np.zeros(len(needles), bool), 1
    while len(alive):
        s = flat[ends[alive] - t] * n
        left[alive], right[alive] = np.searchsorted(keys, s + left[alive]), np.searchsorted(keys, s + right[alive])
        alive = alive[left[alive] < right[alive]]
        done[alive[size[alive] == t]] = True
        alive = alive[size[alive] > t]
        t += 1
    return done


class Stored:
    """A shard's transform as it is stored, searched by its checkpoints or, for many needles, sorted anew."""

    def __init__(self, length: int, c, body: bytes, end_row: int, marks: bytes, every: int, checks: bytes):
        self.n, self.c, self.every = length, np.asarray(c), every
        self.body, self.end_row, self.marks = np.frombuffer(body, np.uint8), end_row, np.frombuffer(marks, np.uint32)
        self.checks = np.frombuffer(checks, np.uint32).reshape(-1, SYMBOLS)
        self.odd = np.sort(np.r_[self.marks.astype(np.int64), end_row])

    def occ(self, byte: int, upto: int) -> int:
        """How often a byte comes in the first ``upto`` rows."""
        block = upto // self.every
        at = block * self.every
        here = int(np.count_nonzero(self.body[at:upto] == byte))
        if byte == 0:
            here -= int(np.searchsorted(self.odd, upto) - np.searchsorted(self.odd, at))
        return int(self.checks[block, byte + 1]) + here

    def contains(self, needle: bytes) -> bool:
        left, right = 0, self.n
        for b in reversed(needle):
            left, right = (int(self.c[b + 1]) + self.occ(b, x) for x in (left, right))
            if left >= right:
                return False
        return bool(needle)

    def symbols(self) -> np.ndarray:
        out = self.body.astype(np.uint16) + np.uint16(1)
        out[self.end_row], out[self.marks] = END, MARK
        return out

    def search(self, needles: list[bytes]) -> np.ndarray:
        if len(needles) * ROWS_A_NEEDLE < self.n:
            return np.array([self.contains(x) for x in needles], bool)
        return search_many(needles, self.symbols())


def build_index(segments: DataFrame, check_every: int = CHECK_EVERY) -> DataFrame:
    """One row of index for each shard of (shard_id, file_ord, seg_ord, content)."""

    def run(batches):
        held: list[bytes] = []
        shard = None

        def row():
            bwt, c = transform(symbols(held))
            marks = narrow(np.flatnonzero(bwt == MARK))
            flat = np.where((bwt == END) | (bwt == MARK), 0, bwt.astype(np.int16) - 1).astype(np.uint8)
            body = [[shard], [len(bwt)], [c.tolist()], [flat.tobytes()], [int(np.flatnonzero(bwt == END)[0])], [marks.tobytes()], [check_every], [checkpoints(bwt, check_every).tobytes()]]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(body, kinds)], [x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for sid, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if sid != shard:
                    if shard is not None:
                        yield row()
                    shard, held = sid, []
                held.append(body.as_py())
        if shard is not None:
            yield row()

    rows = by_key(segments.select("shard_id", "file_ord", "seg_ord", "content"), "shard_id").sortWithinPartitions("shard_id", "file_ord", "seg_ord")
    return rows.select("shard_id", "content").mapInArrow(run, INDEX)


def backward_search(index: DataFrame, queries: DataFrame, key: str = "line_no", needle: str = "needle", max_needle_bytes: int | None = None) -> DataFrame:
    """(key, found) by backward search over every shard, for each row of ``queries``, whatever its key. The distinct
    needles go to the tasks, up to about ``max_needle_bytes`` (as many as a scan has) for one pass over the index; more
    are searched for in several."""

    def run(batches, shared):
        needles = shared.value
        left = np.arange(len(needles))
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(7))):
                hit = Stored(*(x.as_py() for x in row)).search([needles[i] for i in left]) if len(left) else np.empty(0, bool)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array([needles[i] for i in left[hit]], pa.binary())], ["__needle"])
                    left = left[~hit]

    rows, hits = index.select("length", "c", "bwt", "end_row", "marks", "check_every", "checks"), []
    for some in in_passes(distinct_needles(queries, needle), max_needle_bytes):
        shared = index.sparkSession.sparkContext.broadcast(some)
        hits.append(rows.mapInArrow(lambda it, b=shared: run(it, b), "__needle binary"))
    return answered(queries, hits, key, needle)


def symbol_counts(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, sym, n): how often each symbol comes in each content, the end of the text with it."""

    def run(batches):
        for batch in batches:
            ks, syms, ns = [], [], []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if body.is_valid:
                    counts = np.bincount(symbols([body.as_py()]), minlength=SYMBOLS)
                    at = np.flatnonzero(counts)
                    ks += [k] * len(at)
                    syms.append(at)
                    ns.append(counts[at])
            if syms:
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(np.concatenate(syms), pa.int32()), pa.array(np.concatenate(ns))], [key, "sym", "n"])

    rows = df.select(F.col(key).cast("bigint"), as_bytes(F.col(content))).mapInArrow(run, f"{key} bigint, sym int, n bigint")
    return rows.groupBy(key, "sym").agg(F.sum("n").alias("n"))


def c_table(counts: DataFrame, key: str) -> DataFrame:
    """(key, sym, c): the symbols smaller than each that occurs, from its counts."""
    before = Window.partitionBy(key).orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, "sym", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("c"))


def suffixes(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, rk, pos, prev): the suffixes of each content in order by window functions, the empty one first, with the
    symbol before each. It writes out every suffix: for short contents."""
    body = as_bytes(F.col(content))
    rows = df.select(F.col(key), body.alias("__body")).where("__body IS NOT NULL").withColumn("pos", F.explode(F.sequence(F.lit(0), F.octet_length("__body"))))
    rows = rows.withColumn("suffix", F.substring("__body", F.col("pos") + 1, F.octet_length("__body")))
    last = F.when(F.col("pos") == 0, END).otherwise(F.conv(F.hex(F.substring("__body", F.greatest("pos", F.lit(1)), F.lit(1))), 16, 10).cast("int") + 1)
    rk = F.row_number().over(Window.partitionBy(key).orderBy("suffix")).cast("bigint") - 1
    return rows.select(key, rk.alias("rk"), F.col("pos").cast("bigint").alias("pos"), last.alias("prev"))


def suffix_doubling(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``suffixes`` by prefix doubling in Spark's own operators: every position gets the rank of its first symbol, then
    again and again the rank of its own rank and of the one as far on as is sorted by now, twice as far each time, until
    no two are equal. Rows are (key, pos, rank), never suffixes; each round is cut to the shared folder."""
    body = as_bytes(F.col(content))
    rows = df.select(F.col(key), body.alias("__body")).where("__body IS NOT NULL").withColumn("pos", F.explode(F.sequence(F.lit(0), F.octet_length("__body"))))
    size = F.octet_length("__body")
    here = F.when(F.col("pos") < size, F.conv(F.hex(F.substring("__body", F.col("pos") + 1, F.lit(1))), 16, 10).cast("bigint") + 1).otherwise(F.lit(END).cast("bigint"))
    prev = F.when(F.col("pos") == 0, END).otherwise(F.conv(F.hex(F.substring("__body", F.greatest("pos", F.lit(1)), F.lit(1))), 16, 10).cast("int") + 1)
    shared_dir(df.sparkSession)
    at = rows.select(key, F.col("pos").cast("bigint").alias("pos"), prev.alias("prev"), here.alias("rank")).checkpoint()
    ahead = 1
    while True:
        after = F.coalesce(F.lead("rank", ahead).over(Window.partitionBy(key).orderBy("pos")), F.lit(-1))
        at = at.withColumn("after", after).withColumn("rank", F.rank().over(Window.partitionBy(key).orderBy("rank", "after")).cast("bigint")).drop("after").checkpoint()
        if at.groupBy(key, "rank").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return at.select(key, (F.col("rank") - 1).alias("rk"), "pos", "prev")
        ahead *= 2


def suffix_rows(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``suffixes`` for contents of any length, sorted in numpy."""

    def run(batches):
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if body.is_valid:
                    text = symbols([body.as_py()])
                    order = suffix_array(text)
                    n = len(order)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int64)), pa.array(np.arange(n)), pa.array(order), pa.array(text[order - 1], pa.int32())], [key, "rk", "pos", "prev"])

    return df.select(F.col(key).cast("bigint"), as_bytes(F.col(content))).mapInArrow(run, f"{key} bigint, rk bigint, pos bigint, prev int")


def rank_checkpoints(bwt: DataFrame, key: str, every: int = CHECK_EVERY) -> DataFrame:
    """(key, block, sym, n): how often each symbol of a BWT (key, rk, prev) comes before row block * every, for the
    symbols that occur and every block up to the one behind the last full one."""
    per = bwt.groupBy(key, F.floor(F.col("rk") / every).alias("block"), F.col("prev").alias("sym")).agg(F.count("*").alias("here"))
    size = bwt.groupBy(key).agg(F.count("*").alias("size"))
    grid = size.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("size") / every)))).select(key, "block")
    grid = grid.join(bwt.select(key, F.col("prev").alias("sym")).distinct(), key)
    before = Window.partitionBy(key, "sym").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return grid.join(per, [key, "block", "sym"], "left").select(key, "block", "sym", F.coalesce(F.sum("here").over(before), F.lit(0)).cast("bigint").alias("n"))


def occ_rank(bwt: DataFrame, key: str) -> DataFrame:
    """(key, rk, sym, occ): for each row of a BWT, how often its own symbol came before it."""
    own = Window.partitionBy(key, "prev").orderBy("rk")
    return bwt.select(key, "rk", F.col("prev").alias("sym"), (F.row_number().over(own).cast("bigint") - 1).alias("occ"))
