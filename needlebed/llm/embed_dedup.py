"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Vectors that are equal once they have length 1 are one from the start, told apart by a 64-bit hash. Into the tables go
that hash and 64 more signs, not the vectors: within a bucket, signs that differ in too many places rule a pair out.
What is left falls into components of vectors that may be alike; of these the vectors themselves are fetched, each once
for a component of usual size, and the exact cosine decides.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needlebed.llm.common import cut, fresh, need, small_enough
from needlebed.llm.graph import connected_components

THRESHOLD, RECALL, LOAD, SEED = 0.95, 0.98, 4.0, 7
#: A group of up to so many vectors is multiplied out at once; members, about, of a part of a large group.
SMALL, TILE = 512, 2048
#: Signs that travel, and the standard errors that their number of differences may have above what it is at the threshold.
SIGNS, SLACK = 64, 4.0


def table_shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL, load: float = LOAD) -> tuple[int, int]:
    """(bits of a signature, tables). Bits grow with the logarithm of ``n`` so that a bucket of unrelated vectors holds
    ``load``; there are as many tables as a pair exactly at the threshold needs to meet in one with chance ``recall``.
    """
    bits = min(60, max(4, math.ceil(math.log2(max(n, 1) / load)))) if n > load else 4
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def most_apart(threshold: float = THRESHOLD, signs: int = SIGNS) -> int:
    """Signs in which a pair at the threshold differs, at most, but for one in tens of thousands."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(signs * p + SLACK * math.sqrt(signs * p * (1 - p)))


def _units(ids: pa.Array, vecs: pa.Array):
    """(rows, vectors of length 1, their hashes) by dimension, some at a time; vectors without a direction are left out."""
    off = vecs.offsets.to_numpy()
    width, start = np.diff(off), off[:-1]
    flat = vecs.values.to_numpy(zero_copy_only=False).astype(np.float32)
    for dim in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == dim)
        for part in np.array_split(rows, max(1, len(rows) // 1024)):
            x = flat[start[part][:, None] + np.arange(dim)]
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            x = (x[good] / norm[good][:, None]).astype(np.float32) + np.float32(0)
            yield part[good], x, [int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in x]


def _sign(batches, bits: int, tables: int, seed: int):
    planes: dict[int, np.ndarray] = {}
    weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.int64)
    for batch in batches:
        for part, x, eid in _units(batch.column(0), batch.column(1)):
            dim = x.shape[1]
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits + SIGNS)).astype(np.float32)
            up = (x @ planes[dim]) > 0
            sig = up[:, : tables * bits].reshape(len(part), tables, bits) @ weights
            key = (sig.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(tables, dtype=np.uint64)[None, :] + np.uint64(dim << 20)) * np.uint64(0xC2B2AE3D27D4EB4F)
            signs = np.packbits(up[:, tables * bits :], axis=1).view(np.int64)[:, 0] if len(part) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, tables), pa.int32()), pa.array(key.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), pa.array(eid, pa.int64()), pa.array(signs), lists], ["a", "eid", "signs", "keys"])


def _span(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of 0 .. n - 1 for which ``near(i, rest)`` is true: every member that is reached is
    compared with all that aren't yet, so nothing is missed, and a tight group of m takes m comparisons, not m * m."""
    out, rest = [], np.arange(n)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            out += [(int(i), int(j)) for j in rest[hit]]
            queue += list(rest[hit])
            rest = rest[~hit]
    return out


def _links(ids: np.ndarray, x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The pairs with at least that cosine, or where they are many a spanning forest of them."""
    least = threshold - 1e-6
    if len(ids) <= SMALL:
        y = x.astype(np.float64)
        i, j = np.nonzero(np.triu(y @ y.T >= least, 1))
        if len(i) <= 2 * len(ids):
            return list(zip(ids[i], ids[j]))
    return [(ids[i], ids[j]) for i, j in _span(len(ids), lambda i, rest: x[rest].astype(np.float64) @ x[i].astype(np.float64) >= least)]


def _pairs(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(p[i]) for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def _by_key(batches, linked):
    """``linked(columns)`` of the rows of each key, of batches sorted by their first column; a key may reach over batches."""
    held = None
    for batch in batches:
        columns = batch.columns if held is None else [pa.concat_arrays([h, c]) for h, c in zip(held, batch.columns)]
        key = columns[0].to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        first = np.flatnonzero(np.r_[True, key[1:last] != key[: last - 1]]) if last else np.empty(0, np.int64)
        out: list[tuple[int, int]] = []
        for s, e in zip(first, np.r_[first[1:], last]):
            if e - s > 1:
                out += linked([c.slice(s, e - s) for c in columns[1:]])
        held = [c.slice(last) for c in columns]
        yield _pairs(out)
    if held is not None and len(held[0]) > 1:
        yield _pairs(linked(held[1:]))


def _may_be_alike(columns, most: int) -> list[tuple[int, int]]:
    eid, signs = columns[0].to_numpy(), columns[1].to_numpy().view(np.uint64)
    return [(eid[i], eid[j]) for i, j in _span(len(eid), lambda i, rest: np.bitwise_count(signs[rest] ^ signs[i]) <= most)]


def _are_alike(columns, threshold: float) -> list[tuple[int, int]]:
    eid, vecs = columns[0].to_numpy(), columns[1].to_pylist()
    eid, at = np.unique(eid, return_index=True)
    out = []
    for width in {len(vecs[i]) for i in at}:
        own = [k for k, i in enumerate(at) if len(vecs[i]) == width]
        out += _links(eid[own], np.frombuffer(b"".join(vecs[at[k]] for k in own), np.float32).reshape(len(own), -1), threshold)
    return out


def _good(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    good = vectors.select(F.col(id_col).cast("bigint").alias("a"), F.col(vec_col).cast("array<float>").alias("vec"))
    return good.where(F.col("a").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull()))


def _candidates(base: DataFrame, most: int) -> DataFrame:
    """(node, component): groups of vectors that meet in buckets with signs near enough."""
    own = base.groupBy("eid").agg(F.first("signs").alias("signs"), F.first("keys").alias("keys"))
    met = own.select(F.explode("keys").alias("bucket"), "eid", "signs").repartition("bucket").sortWithinPartitions("bucket")
    return connected_components(met.mapInArrow(lambda it: _by_key(it, lambda c: _may_be_alike(c, most)), "a bigint, b bigint"))


def near_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, load: float = LOAD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(a, eid) of each vector with a direction, its id and the hash of its direction, and (a, b): pairs of such hashes
    that span every group of vectors whose cosine is at least ``threshold``."""
    good = _good(vectors, id_col, vec_col)
    bits, tables = table_shape(vectors.count(), threshold, recall, load)
    base = cut(good.mapInArrow(lambda it: _sign(it, bits, tables, seed), "a bigint, eid bigint, signs bigint, keys array<bigint>"))
    maybe = _candidates(base, most_apart(threshold))
    # A component larger than a tile is dealt to parts, and each pair of parts is compared.
    size = Window.partitionBy("component")
    placed = cut(maybe.withColumn("parts", F.ceil(F.count("*").over(size) / TILE)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))))
    wanted = cut(base.join(placed, F.col("eid") == F.col("node")).groupBy("eid").agg(F.min("a").alias("id"), F.first("component").alias("c"), F.first("parts").alias("parts"), F.first("part").alias("part")))

    def fetched(batches):
        for batch in batches:
            want = batch.column(2).to_numpy()
            for part, x, eid in _units(batch.column(0), batch.column(1)):
                same = np.flatnonzero(np.array(eid, np.int64) == want[part])
                rows = pa.array(part[same])
                vec = pa.array([x[i].tobytes() for i in same], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in (2, 3, 4, 5)] + [vec], ["eid", "c", "parts", "part", "vec"])

    rows = good.join(small_enough(wanted, wanted.count(), 64), F.col("a") == F.col("id")).select("a", "vec", "eid", "c", "parts", "part")
    rows = rows.mapInArrow(fetched, "eid bigint, c bigint, parts bigint, part bigint, vec binary")
    other = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda p: p != F.col("part")))
    rows = rows.withColumn("other", F.explode(other)).select(F.xxhash64("c", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "eid", "vec")
    exact = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda it: _by_key(it, lambda c: _are_alike(c, threshold)), "a bigint, b bigint")
    return base.select("a", "eid"), exact


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, load: float = LOAD, seed: int = SEED) -> DataFrame:
    """``vectors`` with ``group_id``, the smallest id of its group, and ``keep``, true for the row that stays.

    Groups are the connected components of the pairs with a cosine of at least ``threshold``. A row whose embedding is
    null, empty, zero, not finite or has a null element resembles nothing and is its own group; so is a row with a
    null id, which is kept with a null ``group_id``. Vectors of unequal length are never alike; very long ones are vectors
    like others. Rows with equal ids are one vector of which any row may bring a link; all of them get the group, and of
    a kept id all rows are kept. An empty table gives an empty table. New names get underscores in front where
    ``vectors`` has such columns.
    """
    need(vectors, id_col, vec_col)
    group, keep, node = fresh(vectors, "group_id", "keep", "node")
    rows, links = near_links(vectors, id_col, vec_col, threshold, recall, load, seed)
    # Vectors of one id are linked to its smallest hash.
    first = rows.groupBy("a").agg(F.min("eid").alias("m"), F.max("eid").alias("n")).where("m <> n").select("a", "m")
    same = rows.join(first, "a").select(F.col("eid").alias("a"), F.col("m").alias("b"))
    named = connected_components(links.unionAll(same)).select(F.col("node").alias("eid"), "component")
    whole = rows.join(named, "eid", "left").select("a", F.coalesce("component", "eid").alias("c"))
    # Only groups of several ids are joined to the rows.
    least = whole.groupBy("c").agg(F.min("a").alias("m"), F.max("a").alias("n")).where("m <> n").select("c", "m")
    parts = cut(whole.join(least, "c").groupBy("a").agg(F.min("m").alias("m")))
    parts = small_enough(parts.select(F.col("a").alias(node), F.col("m").alias(group)), parts.count(), 32)
    out = vectors.join(parts, F.col(id_col).cast("bigint") == F.col(node), "left").withColumn(group, F.coalesce(F.col(group), F.col(id_col).cast("bigint")))
    return out.withColumn(keep, F.coalesce(F.col(group) == F.col(id_col), F.lit(True))).select(*vectors.columns, group, keep)
