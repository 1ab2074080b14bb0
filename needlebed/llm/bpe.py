"""Byte-pair encoding and decoding with a contiguous array of ranks.

A text is split by the tokenizer's pattern. A short word keeps a list of part boundaries and, beside it, the rank of
each pair of adjacent parts: the minimum is looked for again and again, the boundary it stands for is deleted, and
the two ranks next to it are refreshed. That is quadratic, so a long word goes through a heap over linked parts, which
merges the same pairs in the same order.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needlebed.llm.common import fresh, need

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 60
#: Bytes from which a word is long; words kept in the memory of a task.
LONG, CACHED = 128, 200_000
#: Characters of text, about, in a batch that goes back to Spark.
BATCH_CHARS = 1 << 20


def load_ranks(path: str = RANKS_PATH) -> dict[bytes, int]:
    """Token to rank; a line of the file is the token in base64, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    edge = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == NONE:
            break
        i = rank.index(least)
        del edge[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[edge[i] : edge[i + 2]], NONE)
        if i:
            rank[i - 1] = get(word[edge[i - 1] : edge[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(edge, edge[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, n = ranks.get, len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j], after[i] = 0, end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]], NONE)) != NONE:
                heapq.heappush(heap, (r, i, after[end]))
        p = before[i]
        if p >= 0 and (r := get(word[p:end], NONE)) != NONE:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return (merge_short if len(word) < LONG else merge_long)(word, ranks)


class Words(dict):
    """Word to its tokens, worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str):
        tokens = tuple(encode_word(word.encode(), self.ranks))
        if len(word) < LONG:
            self[word] = tokens
        return tokens


def encode_text(text: str, words: Words, split) -> np.ndarray:
    return np.fromiter(chain.from_iterable(map(words.__getitem__, split(text))), np.int32)


def decode_tokens(tokens, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, tokens))


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def bpe_encode(docs: DataFrame, text_col: str = "text", ranks_path: str = RANKS_PATH, pattern: str = PATTERN, drop_text: bool = True) -> DataFrame:
    """``docs`` with ``tokens`` (array of int), ``n_tokens`` and ``round_trip``; ``text_col`` goes if ``drop_text``.

    Each text is decoded again, and ``round_trip`` says whether the very text came out. Whole texts are encoded,
    whatever their length; the empty text has no tokens; a null text has null in all three columns. Special tokens'
    strings are ordinary text. Bytes that aren't UTF-8 are encoded as U+FFFD, and such a text's ``round_trip`` is false.
    Rows are handled one by one, repeated rows each. New names get underscores in front where ``docs`` has such
    columns. An empty table gives an empty table. The vocabulary is read on the driver and broadcast: some megabytes,
    whatever the data.
    """
    need(docs, text_col)
    *names, raw = fresh(docs, "tokens", "n_tokens", "round_trip", "bpe_bytes")
    keep = [c for c in docs.columns if not (drop_text and c == text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        ranks = shared.value
        words, table, split = Words(ranks), token_table(ranks), regex.compile(pattern).findall
        for batch in batches:
            texts, start = batch.column(len(keep)), 0
            kept = batch.select(keep)
            while start < len(texts):
                found, right, chars, at = [], [], 0, start
                while at < len(texts) and chars < BATCH_CHARS:
                    text = texts[at].as_py()
                    at += 1
                    if text is None:
                        found.append(None)
                        right.append(None)
                        continue
                    chars += len(text)
                    tokens = encode_text(text.decode(errors="replace"), words, split)
                    found.append(tokens)
                    right.append(decode_tokens(tokens.tolist(), table) == text)
                ends = np.cumsum([0] + [0 if t is None else len(t) for t in found])
                flat = np.concatenate([t for t in found if t is not None] or [np.empty(0, np.int32)])
                off = pa.array(ends, pa.int32(), mask=np.array([t is None for t in found] + [False]))
                lists = pa.ListArray.from_arrays(off, pa.array(flat, pa.int32()))
                counts = pa.array([None if t is None else len(t) for t in found], pa.int32())
                part = kept.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, counts, pa.array(right, pa.bool_())], [*keep, *names])
                start = at
                if len(words) > CACHED:
                    words.clear()

    fields = [f for f in docs.schema.fields if f.name in keep]
    added = [T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.BooleanType())]
    return docs.select(*keep, F.col(text_col).cast("binary").alias(raw)).mapInArrow(run, T.StructType([*fields, *added]))


def bpe_decode(encoded: DataFrame, tokens_col: str = "tokens", out_col: str = "text", ranks_path: str = RANKS_PATH) -> DataFrame:
    """``encoded`` with the text of its tokens in ``out_col``, in place of a column of that name.

    Null tokens give a null text, no tokens the empty text. Bytes that aren't UTF-8 become U+FFFD; a token that the
    vocabulary lacks, or a null among the tokens, is an error.
    """
    need(encoded, tokens_col)
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    keep = [c for c in encoded.columns if c != out_col]

    def run(batches):
        table = token_table(shared.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(tokens_col)).to_pylist()
            texts = [None if t is None else decode_tokens(t, table).decode(errors="replace") for t in lists]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(texts, pa.string())], [*keep, out_col])

    fields = [f for f in encoded.schema.fields if f.name in keep]
    need_cols = keep if tokens_col in keep else [*keep, tokens_col]
    return encoded.select(*need_cols).mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.StringType())]))
