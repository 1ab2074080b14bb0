"""Language-model scoring with a hashed maximum-entropy model.

The next word's class, then its part of that class, then the word itself, each come from a softmax over sums of weight
rows. The rows are found by hashing the features of the context, which are made of the words themselves: the last word,
the last two, the word before the last (a skip), and the last with the third last (a skip pair). Frequent words have an
outcome each, all others share a fourth of the outcomes. How many outcomes and weight rows there are follows from the
counted words, up to bounds that are parameters, since the model is broadcast.

Within a shared outcome a word has its exact part of all that was counted there, so every word of the corpus has a
probability of its own, however many there are. These counts aren't bounded: the most frequent are broadcast, all others
stay in the shared folder in parts by hash, and the words to score go there and come back as sums.

Training goes over every document once. Documents belong to rounds by a hash of their text, later rounds being larger.
In a round all tasks work at the same weights and send the two halves of the gradient of each row they touched: how often
each outcome was observed, and how often the model expects it, which is estimated by draws from its own distribution at
every word. These are summed, and each weight moves along its gradient by log((observed + a) / (expected + a)) / features,
the step of iterative scaling. Both halves are whole numbers that hang on texts alone, so what is learnt is the same
however the corpus is cut into partitions.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needlebed.llm.common import cut, fresh, need, work_path
from needlebed.llm.words import mix, stretches, word_hashes

#: Bounds of the broadcast model: width ** 3 outcomes, and 3 tables of 2 ** bits rows of ``width`` numbers.
MAX_WIDTH, MAX_BITS = 16, 16
#: The parts of the corpus that the rounds train on, of 128.
ROUNDS = (1, 1, 2, 4, 8, 16, 32, 64)
SMOOTH, STEP, DRAWS = 3.0, 0.25, 2
#: Words that a task trains on, at least, while there are fewer tasks than cores, and beyond: each sends its counts once.
FEW_WORDS, TASK_WORDS = 1 << 19, 1 << 23
#: Tasks from which the counts are summed in two steps.
FAN = 256
BATCH_CHARS, STORED_WORDS, BLOCK, BLOCK_ROWS = 1 << 17, 1 << 16, 1 << 13, 1024
LEVELS, FEATURES = 3, 4
#: Words with a shared outcome whose counts are broadcast, at most; words of the corpus by part of the counts; words that
#: a task holds before it sends them.
COMMON, PART_WORDS, HELD_WORDS = 1 << 20, 1 << 23, 1 << 20
#: Counts a row, and what whole numbers stand for 1 in logarithms, so that sums don't hang on their order.
ROW_WORDS, UNIT = 1 << 18, float(1 << 32)
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_PAIR, _PREFIX, _ROW = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(1 << 32)


def short_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as 32-bit hashes, and where each text's begin."""
    word, starts = word_hashes(texts)
    return (word >> np.uint64(32)).astype(np.uint32), starts


def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The distinct numbers that come first, sorted, and the sums of what stands beside them."""
    h, *sums = (np.concatenate(x) for x in zip(*held))
    if not len(h):
        return h, *sums
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], *(np.add.reduceat(x[order], first) for x in sums)


def count_words(kept: DataFrame) -> DataFrame:
    """(word, n): how often each hash of a word occurs in the stored words."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(h, c):
            return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(c)], ["word", "n"])

        for batch in batches:
            for cell in batch.column(0):
                held.append(np.unique(np.frombuffer(cell.as_py(), np.uint32), return_counts=True))
                if len(held) >= 64:
                    held = [merged(held)]
                    if len(held[0][0]) > 2_000_000:
                        yield out(*held[0])
                        held = []
        if held:
            yield out(*merged(held))

    return kept.select("word").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Lookup:
    """Where hashes stand among sorted distinct ones, and whether they are among them; found by their first bits."""

    def __init__(self, known: np.ndarray):
        bits = len(known).bit_length() + 1
        self.known, self.shift = known, known.dtype.type(8 * known.itemsize - bits)
        self.first = np.searchsorted(known, np.arange(1 << bits).astype(known.dtype) << self.shift).astype(np.int32)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, last = self.known, len(self.known) - 1
        if last < 0:
            return np.zeros(len(h), np.int32), np.zeros(len(h), bool)
        at = np.minimum(self.first[h >> self.shift], np.int32(last))
        short = np.flatnonzero(known[at] < h)
        while len(short):
            short = short[at[short] < last]
            at[short] += 1
            short = short[known[at[short]] < h[short]]
        return at, known[at] == h


@dataclass
class Rest:
    """The counts of the words with a shared outcome, by 64-bit hash: in ``path`` all of them, in ``parts``. ``sizes``: how
    many words each shared outcome got. ``least``: the ``magnitude`` from which words are in ``common``, sorted, with their
    ``worth``. ``tail``: whether there are others."""

    path: str
    parts: int
    sizes: np.ndarray
    least: int
    common: np.ndarray
    worth: np.ndarray
    tail: bool

    @cached_property
    def find(self) -> Lookup:
        return Lookup(self.common)


@dataclass
class Model:
    """``known``: the sorted hashes of words with an outcome of their own, ``outcome``: these outcomes, by frequency,
    so that a class holds words about as frequent. ``bias``: what words have without a context, by level and what the
    levels before have chosen. ``weights``: by level, a row for each hashed feature. ``rest``: the counts of all words
    that share outcomes; without it, or for a model without training, these words are worth their outcome."""

    width: int
    known: np.ndarray
    outcome: np.ndarray
    bias: list[np.ndarray]
    weights: list[np.ndarray]
    rest: Rest | None = None

    @property
    def bits(self) -> int:
        return len(self.weights[0]).bit_length() - 1

    @cached_property
    def find(self) -> Lookup:
        return Lookup(self.known)

    def outcomes(self, word: np.ndarray) -> np.ndarray:
        own = own_outcomes(self.width)
        out = (own + word % np.uint32(self.width**LEVELS - own)).astype(np.uint16)
        at, hit = self.find(word)
        out[hit] = self.outcome[at[hit]]
        return out


def own_outcomes(width: int) -> int:
    return width**LEVELS - width**LEVELS // 4


def new_model(top: np.ndarray, counts: np.ndarray | None = None, total: int = 0, width: int = MAX_WIDTH, bits: int = MAX_BITS) -> Model:
    """A model without training whose own outcomes go to the hashes ``top``, most frequent first. With their ``counts``
    and the ``total`` of all words, it gives words their relative frequency; without, all the same."""
    own, every = own_outcomes(width), width**LEVELS
    top = top[:own].astype(np.uint32)
    order = np.argsort(top)
    freq = np.ones(every)
    if counts is not None and total:
        n = counts[:own].astype(np.float64)
        freq[: len(n)] += n
        freq[own:] += max(0.0, total - n.sum()) / (every - own)
    freq = freq.reshape(width, width, width)
    logs = [np.log(f) for f in (freq.sum((1, 2))[None, :], freq.sum(2), freq.reshape(-1, width))]
    bias = [(x - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)) - x.max(1, keepdims=True)).astype(np.float32) for x in logs]
    return Model(width, top[order], order.astype(np.uint16), bias, [np.zeros((1 << bits, width), np.float32) for _ in range(LEVELS)])


def places(n: int, starts: np.ndarray) -> np.ndarray:
    """How many words of its text come before each word, 3 at most."""
    out = np.full(n, 3, np.uint8)
    for i in (2, 1, 0):
        at = starts[:-1] + i
        out[at[at < starts[1:]]] = i
    return out


def cases(model: Model, word: np.ndarray, outcome: np.ndarray, place: np.ndarray):
    """Blocks of (first, choices, prefixes, rows): by level what is chosen, what was chosen before, as one number, and
    by feature the weight rows."""
    w, bits = model.width, model.bits
    shift, kind = np.uint64(64 - bits), np.uint16 if bits <= 16 else np.uint32
    for s in range(0, len(word), BLOCK):
        e = min(len(word), s + BLOCK)
        back = []
        for i in (1, 2, 3):
            x = np.full(e - s, _NONE, np.uint64)
            lo = max(s, i)
            x[lo - s :] = word[lo - i : e - i] if e > lo else 0
            x[place[s:e] < i] = _NONE
            back.append(x)
        a, b, c = back
        hashed = [mix((f + np.uint64(1)) * m) for f, m in zip((a, a * _PAIR + b, b, a * _PAIR + c), _SALT)]
        y = outcome[s:e].astype(np.int64)
        choices = [y // (w * w), y // w % w, y % w]
        prefixes = [None, choices[0], y // w]
        rows = []
        for level, p in enumerate(prefixes):
            salt = np.uint64(level) * _SALT[1] if p is None else (p.astype(np.uint64) + np.uint64(level << 32)) * _PREFIX
            rows.append([((h ^ salt) * _ROW >> shift).astype(kind) for h in hashed])
        yield s, choices, prefixes, rows


def _softmax(model: Model, level: int, prefix, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights, and their exponentials."""
    w = model.weights[level]
    s = np.take(w, rows[0], axis=0, mode="clip")
    for r in rows[1:]:
        s += np.take(w, r, axis=0, mode="clip")
    s += model.bias[level] if prefix is None else np.take(model.bias[level], prefix, axis=0)
    np.clip(s, -30, 30, out=s)
    return s, np.exp(s)


def log_probs(model: Model, word: np.ndarray, outcome: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The natural logarithm of each outcome's probability after the words before it in its text."""
    total, one = np.zeros(len(word)), np.ones(model.width, np.float32)
    for at, choices, prefixes, rows in cases(model, word, outcome, places(len(word), starts)):
        n = np.arange(len(choices[0]))
        for level, y in enumerate(choices):
            s, e = _softmax(model, level, prefixes[level], rows[level])
            total[at : at + len(n)] += s[n, y] - np.log(e @ one)
    return total


class Counts:
    """By level and row, how often each outcome was observed, and DRAWS times how often it is expected.

    What is expected of a word is estimated by drawing from the model's own distribution after the same context; the
    draws hang on the text and the place in it alone.
    """

    def __init__(self, model: Model):
        size = model.weights[0].size
        self.model, self.one = model, np.ones(model.width, np.float32)
        self.observed = [np.zeros(size, np.int32) for _ in range(LEVELS)]
        self.expected = [np.zeros(size, np.int32) for _ in range(LEVELS)]

    def add(self, word: np.ndarray, outcome: np.ndarray, starts: np.ndarray) -> None:
        w, full = self.model.width, starts[:-1][starts[1:] > starts[:-1]]
        text = np.repeat(np.add.reduceat(word.astype(np.uint64), full), np.diff(np.r_[full, len(word)]))
        at = np.arange(len(word), dtype=np.uint64) - np.repeat(full, np.diff(np.r_[full, len(word)])).astype(np.uint64)
        luck, one = mix(text * _PAIR + at * _ROW), np.int32(1)
        for s, choices, prefixes, rows in cases(self.model, word, outcome, places(len(word), starts)):
            n = len(choices[0])
            for level, y in enumerate(choices):
                _, e = _softmax(self.model, level, prefixes[level], rows[level])
                e = np.cumsum(e, axis=1)
                u = (luck[s : s + n] >> np.uint64(20 * level)) & np.uint64(0xFFFFF)
                base = [r.astype(np.int64) * w for r in rows[level]]
                for r in base:
                    np.add.at(self.observed[level], r + y, one)
                for d in range(DRAWS):
                    part = ((u.astype(np.float32) + np.float32(0.5)) / np.float32(1 << 20) + np.float32(d)) / np.float32(DRAWS)
                    drawn = np.minimum((e <= (part * e[:, -1])[:, None]) @ self.one, w - 1).astype(np.int64)
                    for r in base:
                        np.add.at(self.expected[level], r + drawn, one)


def step(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return STEP * np.log((observed + SMOOTH) / (expected / DRAWS + SMOOTH))


def packed(counts: np.ndarray) -> bytes:
    """Whole numbers, most of them small: the lower halves, then the upper ones, which are mostly 0."""
    return zlib.compress(counts.astype("<u8" if counts.max(initial=0) >> 32 else "<u4").view("<u2").reshape(len(counts), -1).T.tobytes(), 1)


def unpacked(data: bytes, n: int) -> np.ndarray:
    parts = np.frombuffer(zlib.decompress(data), "<u2").reshape(-1, n)
    return sum(part.astype(np.int64) << 16 * i for i, part in enumerate(parts))


def _summed(n: int, last: bool):
    """Rows sorted by block, added up as they come: (block, observed, expected), at last (block, change)."""

    def run(batches):
        at, held = None, None

        def out():
            if last:
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([step(*held).astype(np.float32).tobytes()])], ["block", "change"])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([packed(h)]) for h in held)], ["block", "observed", "expected"])

        for batch in batches:
            for block, *new in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                new = [unpacked(x.as_py(), n) for x in new]
                if block != at:
                    if at is not None:
                        yield out()
                    at, held = block, new
                else:
                    for h, x in zip(held, new):
                        h += x
        if at is not None:
            yield out()

    return run


def _stored(docs: DataFrame, text_col: str, rounds: tuple[int, ...]) -> DataFrame:
    """(round, n, word, starts): the words of many texts of a round in a row, written once for all rounds."""
    edges = np.cumsum(rounds)
    which = F.pmod(F.xxhash64(text_col), F.lit(int(edges[-1])))
    of = sum((F.when(which >= int(e), 1).otherwise(0) for e in edges[:-1]), F.lit(0)).cast("int")

    def run(batches):
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        held: dict[int, list] = {}

        def out(r):
            parts = held.pop(r)
            word = np.concatenate([p[0] for p in parts])
            sizes = np.concatenate([np.diff(p[1]) for p in parts])
            body = [[r], [len(word)], [word.tobytes()], [np.r_[0, np.cumsum(sizes)].tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(body, kinds)], ["round", "n", "word", "starts"])

        for batch in batches:
            for start, texts in stretches(batch.column(0), BATCH_CHARS):
                r = batch.column(1).slice(start, len(texts)).to_numpy()
                order = np.argsort(r, kind="stable")
                word, starts = short_hashes([texts[i] for i in order])
                first = np.flatnonzero(np.r_[True, r[order][1:] != r[order][:-1]])
                for a, b in zip(first, np.r_[first[1:], len(r)]):
                    s, e, k = starts[a], starts[b], int(r[order[a]])
                    if e > s:
                        held.setdefault(k, []).append((word[s:e], starts[a : b + 1]))
                        if sum(len(p[0]) for p in held[k]) >= STORED_WORDS:
                            yield out(k)
        for k in sorted(held):
            yield out(k)

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary"), of.alias("round"))
    path = work_path(docs.sparkSession, "lm-words")
    rows.mapInArrow(run, "round int, n bigint, word binary, starts binary").write.option("compression", "zstd").partitionBy("round").parquet(path)
    return docs.sparkSession.read.schema("n bigint, word binary, starts binary, round int").parquet(path)


def magnitude(n: np.ndarray) -> np.ndarray:
    return (8 * np.log2(n)).astype(np.int64)


def worth(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The logarithm of a word's part of its outcome, in whole numbers, from its count and the outcome's. What was never
    counted is taken as one more word there that occurred once."""
    return np.rint((np.log(n) - np.log(size + 1)) * UNIT).astype(np.int64)


def parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_part(parts: int, h: np.ndarray, *beside: np.ndarray):
    """By part of the hashes ``h``: (part, what belongs to it)."""
    part = parts_of(h, parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        at = order[edges[p] : edges[p + 1]]
        yield int(p), *(x[at] for x in (h, *beside))


def _row(names: list[str], *numbers) -> pa.RecordBatch:
    """A row of whole numbers and of arrays as bytes."""
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) if isinstance(x, int) else pa.array([x.tobytes()], pa.binary()) for x in numbers], names)


def _arrays(batches, *kinds):
    """The rows that ``_row`` has made, with a type for each of their arrays."""
    for batch in batches:
        for row in zip(*batch.columns):
            yield [x.as_py() if isinstance(x, pa.Int32Scalar) else np.frombuffer(x.as_py(), next(k)) for k in [iter(kinds)] for x in row]


def count_rest(docs: DataFrame, model: Model, total: int, text_col: str = "text") -> Rest:
    """Counts every word of ``docs``, which have ``total``, that has no outcome of its own in ``model``."""
    spark = docs.sparkSession
    parts = max(min(spark.sparkContext.defaultParallelism, total // FEW_WORDS), total // PART_WORDS, 1)
    own, every = own_outcomes(model.width), model.width**LEVELS
    shared, row_words = spark.sparkContext.broadcast(replace(model, bias=[], weights=[])), ROW_WORDS
    kinds, names = "part int, word binary, n binary", ["part", "word", "n"]

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for _, texts in stretches(batch.column(0), BATCH_CHARS):
                word, _ = word_hashes(texts)
                held.append(np.unique(word[shared.value.outcomes((word >> np.uint64(32)).astype(np.uint32)) >= own], return_counts=True))
                if len(held) >= 64:
                    held = [merged(held)]
                    if len(held[0][0]) > 2_000_000:
                        yield from (_row(names, *r) for r in _by_part(parts, *held.pop()))
        if held:
            yield from (_row(names, *r) for r in _by_part(parts, *merged(held)))

    def summed(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for part, *new in _arrays(batches, np.uint64, np.int64):
            held.append(tuple(new))
            if len(held) >= 64:
                held = [merged(held)]
        if held:
            word, n = merged(held)
            sizes = np.bincount(shared.value.outcomes((word >> np.uint64(32)).astype(np.uint32)) - own, n, every - own).astype(np.int64)
            often = np.bincount(magnitude(n), minlength=512)
            for i in range(0, len(word), row_words):
                yield _row([*names, "sizes", "often"], part, word[i : i + row_words], n[i : i + row_words], *((x if i == 0 else x[:0]) for x in (sizes, often)))

    path, kind = work_path(spark, "lm-rest"), f"{kinds}, sizes binary, often binary"
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary"))
    texts.mapInArrow(run, kinds).repartitionById(parts, F.col("part")).mapInArrow(summed, kind).write.parquet(path)
    stored = spark.read.schema(kind).parquet(path)
    sizes, often = np.zeros(every - own, np.int64), np.zeros(512, np.int64)
    for r in stored.where("octet_length(sizes) > 0").select("sizes", "often").toLocalIterator():
        sizes, often = sizes + np.frombuffer(r["sizes"], np.int64), often + np.frombuffer(r["often"], np.int64)
    least = next(i for i in range(513) if often[i:].sum() <= COMMON)

    def frequent(batches):
        for word, n in _arrays(batches, np.uint64, np.int64):
            at = magnitude(n) >= least
            if at.any():
                yield _row(["word", "n"], word[at], n[at])

    got = [(np.frombuffer(r[0], np.uint64), np.frombuffer(r[1], np.int64)) for r in stored.select("word", "n").mapInArrow(frequent, "word binary, n binary").collect()]
    word, n = merged([(np.empty(0, np.uint64), np.empty(0, np.int64)), *got])
    outcome = model.outcomes((word >> np.uint64(32)).astype(np.uint32))
    shared.destroy()
    return Rest(path, parts, sizes, least, word, worth(n, sizes[outcome - own]) if len(word) else np.empty(0, np.int64), bool(often[:least].any()))


def rest_worth(model: Model, whole: np.ndarray, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By word, from its 64-bit hash and outcome, what is to be added to its logarithm, in whole numbers; and which words
    are to be looked up in the parts."""
    add, far = np.zeros(len(whole), np.int64), np.zeros(len(whole), bool)
    rest, at = model.rest, np.flatnonzero(outcome >= own_outcomes(model.width))
    if rest is None or not len(at):
        return add, far
    place, hit = rest.find(whole[at])
    add[at[hit]] = rest.worth[place[hit]]
    if rest.tail:
        far[at[~hit]] = True
    else:
        add[at[~hit]] = worth(1, rest.sizes[outcome[at[~hit]] - own_outcomes(model.width)])
    return add, far


def _tail_sums(rows: DataFrame, model: Model, shared) -> DataFrame:
    """(key, worth, seen) of ``rows`` (words, key): by key, what its words in the parts of the counts are worth together, and
    how many they are; rows with the same key are added up."""
    rest, own, held_words = model.rest, own_outcomes(model.width), HELD_WORDS
    parts, least, names = rest.parts, rest.least, ["part", "step", "word", "beside"]
    kind = "part int, step int, word binary, beside binary"

    def send(batches):
        held, n = [], 0
        for batch in batches:
            for words, key in zip(batch.column(0), batch.column(1).to_numpy()):
                word = np.frombuffer(words.as_py(), np.uint64)
                held.append((word, np.full(len(word), key)))
                n += len(word)
                if n >= held_words:
                    yield from (_row(names, p, 1, *x) for p, *x in _by_part(parts, *(np.concatenate(x) for x in zip(*held))))
                    held, n = [], 0
        if n:
            yield from (_row(names, p, 1, *x) for p, *x in _by_part(parts, *(np.concatenate(x) for x in zip(*held))))

    def look(batches):
        counts, find, held, n = [(np.empty(0, np.uint64), np.empty(0, np.int64))], None, [], 0
        model = shared.value
        size = lambda word: model.rest.sizes[model.outcomes((word >> np.uint64(32)).astype(np.uint32)) - own]
        for _, step, word, beside in _arrays(batches, np.uint64, np.int64):
            if step == 0:
                at = magnitude(beside) < least
                counts.append((word[at], beside[at]))
                continue
            if find is None:
                known, count = merged(counts)
                find, value = Lookup(known), worth(count, size(known))
            (place, hit), add = find(word), np.empty(len(word), np.int64)
            add[hit], add[~hit] = value[place[hit]], worth(1, size(word[~hit]))
            held.append(merged([(beside.view(np.uint64), add, np.ones(len(word), np.int64))]))
            n += len(held[-1][0])
            if n >= held_words:
                yield from (_row(sums, *x) for x in _by_part(parts, *merged(held)))
                held, n = [], 0
        if n:
            yield from (_row(sums, *x) for x in _by_part(parts, *merged(held)))

    def add_up(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for _, *new in _arrays(batches, np.uint64, np.int64, np.int64):
            held.append(tuple(new))
            if len(held) >= 64:
                held = [merged(held)]
        if held:
            key, *totals = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, totals)], ["key", "worth", "seen"])

    sums = ["part", "key", "worth", "seen"]
    stored = rows.sparkSession.read.schema("part int, word binary, n binary").parquet(rest.path)
    both = stored.select("part", F.lit(0).alias("step"), "word", F.col("n").alias("beside")).unionByName(rows.mapInArrow(send, kind))
    found = both.repartitionById(parts, F.col("part")).sortWithinPartitions("step").mapInArrow(look, "part int, key binary, worth binary, seen binary")
    return found.repartitionById(parts, F.col("part")).mapInArrow(add_up, "key bigint, worth bigint, seen bigint")


def train_lm(docs: DataFrame, text_col: str = "text", max_width: int = MAX_WIDTH, max_bits: int = MAX_BITS, rounds: tuple[int, ...] = ROUNDS) -> Model:
    """A model trained on every text of ``docs``.

    Null and empty texts add nothing; without words the model stays uniform. Repeated rows are cases like others. Very
    long texts are worked through in blocks of words. Words that occur once have no outcome of their own; of the others
    the most frequent have, ties going by the hash, as far as ``max_width`` ** 3 outcomes reach; of the outcomes a fourth is
    shared by all other words. Each of these is counted all the same, told apart by a 64-bit hash, and has its exact part
    of what its outcome got. The weight rows grow with the number of words, up to 2 ** ``max_bits`` by level. Other
    columns, whatever their names, aren't read. The words are kept in the shared folder as 32-bit hashes and read again
    by the round that trains on them.
    """
    need(docs, text_col)
    sc = docs.sparkSession.sparkContext
    kept = _stored(docs, text_col, rounds)
    sizes = {r["round"]: r["n"] for r in kept.groupBy("round").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    top = count_words(kept).where("n > 1").orderBy(F.desc("n"), "word").limit(own_outcomes(max_width)).collect()
    words, counts = np.array([r["word"] for r in top], np.uint32), np.array([r["n"] for r in top], np.int64)
    width = next(w for w in range(min(8, max_width), max_width + 1) if own_outcomes(w) >= len(words))
    model = new_model(words, counts, total, width, min(max_bits, max(10, (total // 64).bit_length())))
    size = len(model.weights[0])
    blocks = [(level, i) for level in range(LEVELS) for i in range(0, size, BLOCK_ROWS)]
    for k in sorted(sizes):
        shared = sc.broadcast(model)

        def run(batches):
            sums = None
            for batch in batches:
                for word, starts in zip(batch.column(0), batch.column(1)):
                    sums = sums or Counts(shared.value)
                    word = np.frombuffer(word.as_py(), np.uint32)
                    sums.add(word, shared.value.outcomes(word), np.frombuffer(starts.as_py(), np.int64))
            if sums is not None:
                salt = TaskContext.get().partitionId() % fan
                for b, (level, i) in enumerate(blocks):
                    o, e = (x[level][i * width : (i + BLOCK_ROWS) * width] for x in (sums.observed, sums.expected))
                    if o.any():
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([salt], pa.int32()), pa.array([packed(o)]), pa.array([packed(e)])], ["block", "salt", "observed", "expected"])

        tasks = max(min(sc.defaultParallelism, sizes[k] // FEW_WORDS), sizes[k] // TASK_WORDS, 1)
        fan = 1 if tasks <= FAN else math.isqrt(tasks)
        part = kept.where(F.col("round") == k).select("word", "starts").coalesce(tasks)
        sums, kind = part.mapInArrow(run, "block int, salt int, observed binary, expected binary"), "block int, observed binary, expected binary"
        if fan > 1:
            sums = sums.repartition("block", "salt").sortWithinPartitions("block").select("block", "observed", "expected").mapInArrow(_summed(BLOCK_ROWS * width, False), kind)
        sums = sums.select("block", "observed", "expected").repartition("block").sortWithinPartitions("block")
        for r in sums.mapInArrow(_summed(BLOCK_ROWS * width, True), "block int, change binary").collect():
            level, i = blocks[r["block"]]
            model.weights[level][i : i + BLOCK_ROWS] += np.frombuffer(r["change"], np.float32).reshape(-1, width)
        shared.destroy()
    return replace(model, rest=count_rest(docs, model, total, text_col)) if total else model


def score_lm(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``log_prob`` (natural, of all its words) and ``perplexity``.

    Null and empty texts have 0 words, a logarithm of 0 and a null perplexity. Whole texts are scored, very long ones in
    blocks of words. A word that shares its outcome is worth its exact part of it; one that was never counted, the part of
    a word that occurred once. Bytes that aren't UTF-8 count as U+FFFD. Repeated rows have equal scores. New names get
    underscores in front where ``docs`` has such columns. Texts aren't shuffled: words whose counts aren't broadcast go to
    these with a 64-bit hash of their text, and the sums are joined by it; where there are such words, what is scored so far
    is kept in the shared folder.
    """
    need(docs, text_col)
    names = fresh(docs, "n_tokens", "log_prob", "perplexity", "needlebed_key", "needlebed_far", "needlebed_worth", "needlebed_seen")
    count, log_prob, perplexity, key, far_words, far_worth, seen = names
    keep = [c for c in docs.columns if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for start, texts in stretches(batch.column(len(keep)), BATCH_CHARS):
                whole, starts = word_hashes(texts)
                word = (whole >> np.uint64(32)).astype(np.uint32)
                lp, ends, away = np.zeros(len(texts)), np.zeros(len(texts) + 1, np.int64), np.zeros(len(word), bool)
                if len(word):
                    outcome = model.outcomes(word)
                    sums = lambda x, zero: np.diff(np.r_[zero, np.cumsum(x)][starts])
                    add, away = rest_worth(model, whole, outcome)
                    lp = sums(log_probs(model, word, outcome, starts), 0.0) + sums(add, 0) / UNIT
                    ends = np.r_[0, np.cumsum(away)][starts]
                far = pa.Array.from_buffers(pa.binary(), len(texts), [None, *map(pa.py_buffer, ((8 * ends).astype(np.int32), whole[away]))])
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], part.column(len(keep) + 1), pa.array(np.diff(starts), pa.int64()), pa.array(lp), far], [*keep, key, count, log_prob, far_words])

    kinds = [T.StructField(n, k) for n, k in ((key, T.LongType()), (count, T.LongType()), (log_prob, T.DoubleType()), (far_words, T.BinaryType()))]
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + kinds)
    text = F.col(text_col).cast("binary")
    scored = docs.select(*keep, text.alias(text_col), F.xxhash64(text).alias(key)).mapInArrow(run, schema)
    if model.rest is not None and model.rest.tail:
        scored = cut(scored)
        found = _tail_sums(scored.where(F.octet_length(far_words) > 0).select(far_words, key), model, shared)
        # Rows with the same text have sent their words each.
        added = F.expr(f"`{far_worth}` div (`{seen}` div (octet_length(`{far_words}`) div 8))") / F.lit(UNIT)
        scored = scored.join(found.toDF(key, far_worth, seen), key, "left")
        scored = scored.withColumn(log_prob, F.col(log_prob) + F.when(F.octet_length(far_words) > 0, added).otherwise(0.0))
    score = F.when(F.col(count) > 0, F.exp(F.least(F.lit(700.0), -F.col(log_prob) / F.col(count))))
    return scored.select(*keep, count, log_prob, score.alias(perplexity))
