"""MinHash near-dedup with bottom-k sketches from one hash function.

A document is its set of hashed shingles of three words; its sketch holds the k smallest. Documents with the same set
are one from the start. Retained values are inverted into lists. Two sketches that can pass the filter share at least
c values, so each only enters its |sketch| - c + t rarest values, and any such pair still meets in t lists, while values
that thousands of documents share aren't looked up. Pairs that meet in fewer, or whose sets differ too much in size to
reach the threshold, go no further. Overlaps are turned into an estimate over the union sketch, which
filters; the exact Jaccard of the whole sets decides. Every set is first held against one hub, the smallest set of the
lists it is in; that joins most of a group, of thousands too, with as many verdicts as it has members. Then groups
that still meet in a list are compared in tiles: a set goes once to a tile, not once for each pair it is in, and two
groups are left alone as soon as a pair has joined them.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needlebed.llm.common import cut, fresh, id_key, need, small_enough
from needlebed.llm.graph import connected_components
from needlebed.llm.words import mix, stretches, word_hashes

WORDS, K, THRESHOLD = 3, 64, 0.5
#: Standard errors that the filter of the estimate leaves below the threshold.
SLACK = 3.0
BATCH_CHARS = 1 << 20
#: Members, about, at which a group is compared in parts; sketches and sets that a tile holds; pairs in one numpy step.
BLOCK, SKETCHES, SETS, PAIRS = 2048, 8192, 2048, 8192
#: Values of a set that count as one set of a tile, so that long documents fill tiles by their length.
VALUES = 1024
#: Rarest values that two sketches have to share before they are compared, where they need so many to pass at all.
OVERLAP = 3
NONE = np.iinfo(np.int64).max

def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """The sorted, distinct 64-bit hashes of each text's runs of ``n`` lower-case words between blanks. A text with
    fewer words has one, of all its words; a text without words has none."""
    word, of_doc = word_hashes(texts)
    if not len(word):
        return [np.empty(0, np.int64)] * len(texts)
    factor = np.cumprod(np.full(n, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64))
    m = len(word) - n + 1
    runs = mix(reduce(np.add, (word[i : i + m] * factor[i] for i in range(n)))).view(np.int64) if m > 0 else None
    out = []
    for a, b in zip(of_doc, of_doc[1:]):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(mix((word[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, k: int) -> DataFrame:
    """(id, th, eid, size, sketch): the document's id and a hash of its text, the id and the size of its set, its sketch; rows
    without words left out."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for start, texts in stretches(batch.column(2), BATCH_CHARS):
                sets = shingle_sets(texts, n)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    rows = pa.array([start + i for i in full])
                    off = np.cumsum([0] + [min(k, len(sets[i])) for i in full])
                    flat = np.concatenate([sets[i][:k] for i in full])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([set_id(sets[i]) for i in full]), pa.array([len(sets[i]) for i in full]), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))], ["id", "th", "eid", "size", "sketch"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("th", T.LongType()), T.StructField("eid", T.LongType()), T.StructField("size", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard from two sketches: the part of the union's k smallest values that both hold."""
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float((both <= union[-1]).sum()) / len(union) if len(union) else 0.0


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def estimates(one: np.ndarray, two: np.ndarray, k: int = K) -> np.ndarray:
    """``union_estimate`` of many pairs: rows of sketches, filled up to k with NONE."""
    both = np.sort(np.concatenate([one, two], 1), axis=1)
    same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)
    first = both != NONE
    first[:, 1:] &= ~same
    rank = np.cumsum(first, axis=1)
    size = np.minimum(rank[:, -1], k)
    return (same & (rank[:, 1:] <= k)).sum(1) / np.maximum(size, 1)


def _linked(batches, k: int, least: float, threshold: float | None):
    """Rows (tile, kind, x, y, v) sorted by tile, then kind: kind 0 is a set, x its id, y its unit, v its array; kind 1
    is a link of the units x and y. Gives (a, b, ua, ub), one pair of sets for each link of which some pair passes.

    The estimate is over the k smallest of the arrays, which are sketches or whole sets; with a ``threshold`` a pair
    passes if the Jaccard of the whole arrays reaches it too.
    """

    class Tile:
        def __init__(self, key):
            self.key, self.ids, self.units, self.vecs, self.at = key, [], [], [], None

        def ready(self):
            order = np.argsort(np.array(self.units), kind="stable")
            self.ids, self.vecs = np.array(self.ids)[order], [self.vecs[i] for i in order]
            units = np.array(self.units)[order]
            self.heads = np.full((len(order), k), NONE, np.int64)
            for i, v in enumerate(self.vecs):
                self.heads[i, : min(k, len(v))] = v[:k]
            first = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
            self.at = dict(zip(units[first].tolist(), zip(first.tolist(), np.r_[first[1:], len(units)].tolist())))

        def judge(self, links, out):
            rows, ia, ib, n = [], [], [], 0
            for link in links:
                a, b = self.at.get(link[0]), self.at.get(link[1])
                if a and b:
                    i, j = np.arange(*a), np.arange(*b)
                    ia.append(np.repeat(i, len(j)))
                    ib.append(np.tile(j, len(i)))
                    rows.append((link, len(i) * len(j)))
                    n += len(i) * len(j)
                    if n >= PAIRS:
                        self.some(rows, np.concatenate(ia), np.concatenate(ib), out)
                        rows, ia, ib, n = [], [], [], 0
            if rows:
                self.some(rows, np.concatenate(ia), np.concatenate(ib), out)

        def some(self, rows, ia, ib, out):
            good = np.concatenate([estimates(self.heads[ia[i : i + PAIRS]], self.heads[ib[i : i + PAIRS]], k) for i in range(0, len(ia), PAIRS)]) >= least - 1e-12
            of_link, done = np.repeat(np.arange(len(rows)), [r[1] for r in rows]), -1
            for i in np.flatnonzero(good):
                if of_link[i] != done and (threshold is None or jaccard(self.vecs[ia[i]], self.vecs[ib[i]]) >= threshold - 1e-12):
                    done = of_link[i]
                    out.append((self.ids[ia[i]], self.ids[ib[i]], *rows[done][0]))

    tile = None
    for batch in batches:
        out, links = [], []
        column = batch.column(4)
        for i, (key, kind, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            if tile is None or key != tile.key:
                if links:
                    tile.judge(links, out)
                tile, links = Tile(key), []
            if kind == 0:
                tile.ids.append(x)
                tile.units.append(y)
                tile.vecs.append(column[i].values.to_numpy().copy())
            elif len(tile.ids):
                if tile.at is None:
                    tile.ready()
                links.append((x, y))
        if links:
            tile.judge(links, out)
        yield pa.RecordBatch.from_arrays([pa.array([int(p[c]) for p in out], pa.int64()) for c in range(4)], ["a", "b", "ua", "ub"])


def _judged(links: DataFrame, units: DataFrame, n: int, of, tile: int, k: int, least: float, threshold: float | None = None) -> DataFrame:
    """(a, b, ua, ub) of the links (ua, ub) of units (eid, u), ``n`` sets in all, of which some pair of sets passes.
    ``of`` gives the arrays (eid, v) for a table with the ids of those that are needed and its number of rows.

    Units are dealt to tiles that hold about ``tile`` sets; a link belongs to a pair of tiles. A set goes once to each
    pair of tiles in which it has a link, however many it has there.
    """
    g = max(6, math.ceil(n / tile))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(g))
    placed = links.select("ua", "ub", (F.least(place("ua"), place("ub")) * g + F.greatest(place("ua"), place("ub"))).alias("tile"))
    asked = placed.select("tile", F.col("ua").alias("u")).unionAll(placed.select("tile", F.col("ub").alias("u"))).distinct()
    asked = cut(asked.join(units, "u").select("tile", F.col("eid"), "u"))
    rows = asked.count()
    given = of(asked, rows).join(small_enough(asked, rows, 64), "eid").select("tile", F.lit(0).alias("kind"), F.col("eid").alias("x"), F.col("u").alias("y"), "v")
    every = given.unionAll(placed.select("tile", F.lit(1), "ua", "ub", F.lit(None).cast("array<bigint>")))
    return every.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(lambda it: _linked(it, k, least, threshold), "a bigint, b bigint, ua bigint, ub bigint")


def _least_shared(size, least: float):
    """Values that a sketch of so many shares with any that passes."""
    return F.greatest(F.lit(1), F.ceil(size * F.lit(least) - F.lit(1e-9)))


def candidate_lists(entities: DataFrame, least: float, overlap: int = OVERLAP) -> DataFrame:
    """(value, eid): the inverted lists of the values that can bring a pair together, by the rule of the rarest values:
    two sketches that pass meet in ``overlap`` lists, or in as many as the shorter must share if that is fewer."""
    rows = entities.select("eid", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy("value"))).where("df > 1")
    own = Window.partitionBy("eid")
    rows = rows.withColumn("m", F.count("*").over(own)).withColumn("rn", F.row_number().over(own.orderBy("df", "value")))
    c = _least_shared(F.col("k"), least)
    kept = rows.where((F.col("m") >= c) & (F.col("rn") <= F.col("m") - c + F.least(c, F.lit(overlap)))).select("value", "eid")
    return kept.withColumn("n", F.count("*").over(Window.partitionBy("value"))).where("n > 1").drop("n")


def _units(parts: DataFrame) -> DataFrame:
    """(eid, size, c, u): groups (eid, size, c) with their units: a group, or a part of one that has more than BLOCK members."""
    n = F.ceil(F.count("*").over(Window.partitionBy("c")) / BLOCK)
    return parts.withColumn("n", n).select("eid", "size", "c", F.when(F.col("n") > 1, F.xxhash64("c", F.pmod(F.xxhash64("eid"), F.col("n")))).otherwise(F.col("c")).alias("u"))


def _apart(lists: DataFrame, units: DataFrame, k: int, least: float, threshold: float, overlap: int = OVERLAP) -> DataFrame:
    """(ua, ub): the units of different groups of which members meet in enough lists, and are near enough in size."""
    t = F.least(F.lit(overlap), _least_shared(F.least("size", F.lit(k)), least))
    at = lists.join(units, "eid").groupBy("value", "c", "u").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min(t).alias("t"))
    one, two = (at.select("value", *(F.col(n).alias(n + x) for n in ("c", "u", "lo", "hi", "t"))) for x in ("a", "b"))
    sizes = (F.col("hia") >= F.col("lob") * threshold - 1e-9) & (F.col("hib") >= F.col("loa") * threshold - 1e-9)
    met = one.join(two, "value").where((F.col("ca") < F.col("cb")) & sizes).groupBy("ua", "ub").agg(F.count("*").alias("met"), F.min(F.least("ta", "tb")).alias("t"))
    return met.where("met >= t").select("ua", "ub")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, eid, grp): for each row with words its id, a hash of its text, its set, and the group of near copies."""
    need(docs, id_col, text_col)
    rows = cut(sketches(docs, id_col, text_col, n, k))
    least = max(0.0, threshold - SLACK * math.sqrt(threshold * (1 - threshold) / k))
    lists = cut(candidate_lists(rows.select("eid", "sketch").dropDuplicates(["eid"]), least))
    some = cut(lists.select("eid").distinct())
    n_some = some.count()
    inside = rows.join(small_enough(some, n_some, 16), "eid", "left_semi").groupBy("eid").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("sketch").alias("v"))
    inside = cut(inside.select("eid", id_key(F.col("id")).alias("key"), "size", "v"))
    n_sets = max(n_some, (inside.agg(F.sum("size")).first()[0] or 0) // VALUES)

    # The whole sets of the documents that stand for those asked for; one that comes twice does no harm. They are
    # made anew for each use, from no more texts than it needs: to keep them all would take as much room as the texts.
    def whole(batches):
        for batch in batches:
            for _, texts in stretches(batch.column(0), BATCH_CHARS):
                sets = shingle_sets(texts, n)
                off = np.cumsum([0] + [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets]), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(sets)))], ["eid", "v"])

    def sets_of(asked: DataFrame, rows: int) -> DataFrame:
        keys = small_enough(inside.join(small_enough(asked.select("eid").distinct(), rows, 16), "eid", "left_semi").select(F.col("key").alias("__key")), min(rows, n_some), 48)
        texts = docs.select(id_key(F.col(id_col)).alias("__key"), F.col(text_col).cast("binary").alias("__text")).join(keys, "__key", "left_semi")
        return texts.select("__text").mapInArrow(whole, "eid bigint, v array<bigint>")

    # Each set against the hub that it meets in most lists: a hub is the smallest set of a list.
    by_hub = lists.withColumn("hub", F.min("eid").over(Window.partitionBy("value"))).where("eid > hub").groupBy("eid", "hub").agg(F.count("*").alias("met"))
    best = by_hub.withColumn("rn", F.row_number().over(Window.partitionBy("eid").orderBy(F.desc("met"), "hub"))).where("rn = 1").select("eid", "hub")
    own = some.select("eid", F.col("eid").alias("u"))
    sketched = lambda links, units: cut(_judged(links, units, n_some, lambda *_: inside.select("eid", "v"), SKETCHES, k, least).select("ua", "ub"))
    proved = lambda links, units: cut(_judged(links, units, n_sets, sets_of, SETS, k, least, threshold).select("a", "b"))
    edges = proved(sketched(cut(best.select(F.col("hub").alias("ua"), F.col("eid").alias("ub"))), own), own)
    # What is still apart, group against group: first by the sketches, then by the sets.
    found = connected_components(edges).select(F.col("node").alias("eid"), F.col("component").alias("c"))
    units = cut(_units(inside.select("eid", "size").join(found, "eid", "left").withColumn("c", F.coalesce("c", "eid"))))
    more = proved(sketched(cut(_apart(lists, units, k, least, threshold)), units.drop("c")), units.drop("c"))
    named = connected_components(edges.unionAll(more)).select(F.col("node").alias("eid"), F.col("component").alias("grp"))
    return rows.select("id", "th", "eid").join(named, "eid", "left").withColumn("grp", F.coalesce("grp", "eid"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near copies, with the columns of ``docs``.

    Near copies are documents whose shingle sets have a Jaccard of at least ``threshold``; groups are the connected
    components of such pairs. The row with the smallest id of a group stays; null ids come last; of rows with the same
    id the one whose text has the smallest hash, and of wholly repeated rows one. Rows without words (null, empty and
    blank texts) resemble nothing and all stay. Case and blanks make no difference. An empty table gives an empty
    table. Texts are taken whole, however long; bytes that aren't UTF-8 count as U+FFFD. Columns of any names may come
    along. Sets and values are told apart by 64-bit hashes.
    """
    groups = near_groups(docs, id_col, text_col, n, k, threshold).withColumn("key", id_key(F.col("id")))
    first = Window.partitionBy("grp").orderBy(F.col("id").asc_nulls_last(), "th")
    ranked = cut(groups.withColumn("rn", F.row_number().over(first)).withColumn("size", F.count("*").over(Window.partitionBy("grp"))).where("size > 1").select("key", "th", "grp", "rn"))
    # Rows that repeat as a whole share key and hash with the one that stays.
    stays = ranked.where("rn = 1").select("key", "th", F.lit(True).alias("stays"))
    gone = ranked.where("rn > 1").select("key", "th").join(stays, ["key", "th"], "left").groupBy("key", "th").agg(F.max(F.coalesce("stays", F.lit(False))).alias("again"))
    gone = cut(gone)
    n_gone, n_again = gone.agg(F.count("*"), F.count_if("again")).first()
    key, th, again, rn = fresh(docs, "near_key", "near_th", "near_again", "near_rn")
    full = docs.withColumn(key, id_key(F.col(id_col))).withColumn(th, F.xxhash64(text_col))
    names = lambda df: df.select(F.col("key").alias(key), F.col("th").alias(th))
    out = full.join(small_enough(names(gone), n_gone, 64), [key, th], "left_anti").select(*docs.columns)
    if n_again:
        one = Window.partitionBy(key, th).orderBy(*[F.col(c).cast("string") for c in docs.columns])
        rest = full.join(small_enough(names(gone.where("again")), n_again, 64), [key, th], "left_semi")
        out = out.unionAll(rest.withColumn(rn, F.row_number().over(one)).where(F.col(rn) == 1).select(*docs.columns))
    return out
