"""One answer on all paths, whatever the keys; stored filters and transforms against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from needlebed.errors import IndexFormatError
from needlebed.functions import bytesfn as bf
from needlebed.operators import bwt, grams, search
from needlebed.plans import index as ix
from needlebed.plans.index import BuildOptions, build, build_from, open_index


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    return ["".join(rnd.choices("abcdefgh \n", k=rnd.choice([0, 5, 200, 900]))) for _ in range(40)]


@pytest.fixture(scope="module")
def built(spark, texts, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('paths')}/index"
    rows = [(i, f"f{i:03}", len(t), bytearray(t.encode())) for i, t in enumerate(texts)]
    build_from(spark.createDataFrame(rows, "file_ord bigint, path string, size bigint, content binary"), out, BuildOptions(shard_size=600, max_query_bytes=60, check_every=32))
    return open_index(spark, out)


def corpus(spark, bodies):
    rows = [(i, f"f{i:03}", len(b), bytearray(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "file_ord bigint, path string, size bigint, content binary")


@pytest.mark.parametrize("kind", ["bigint", "string", "double", "array<int>"])
def test_keys_of_any_type_repeated_and_null(spark, built, texts, kind):
    t = next(t for t in texts if len(t) > 500)
    asked = [(1, t[:9]), (1, "absent!!!"), (2, "no such"), (2, t[50:80]), (None, t[3:5]), (None, "zzzzzzzzzz"), (3, ""), (3, None), (4, "x" * 61), (5, t[7:12]), (5, t[7:12]), (6, "q"), (7, t[100:160])]
    make = {"bigint": lambda k: k, "string": lambda k: f"key {k}", "double": float, "array<int>": lambda k: [k]}[kind]
    rows = [(None if k is None else make(k), None if n is None else bytearray(n.encode())) for k, n in asked]
    df = spark.createDataFrame(rows, f"k {kind}, needle binary")
    want = sorted((repr(k), bool(n) and len(n) <= 60 and any(bytes(n).decode() in x for x in texts)) for k, n in rows)
    for way in (built.batch, built.batch_pruned, built.batch_backward):
        assert sorted((repr(r[0]), r[1]) for r in way(df, "k").collect()) == want
    pairs = grams.trigram_candidates(built._table("trigram"), df, "k").where("k IS NULL")
    assert pairs.count() == 0
    assert grams.ngram_candidates(grams.unpacked(built._table("ngram")), df.where("needle IS NOT NULL"), "k").where(F.col("k").isNull()).count() == 0


def test_packed_sets():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 3000, 65_535, 65_536, 900_000, grams.GROUP):
        v = np.sort(rnd.choice(grams.GROUP, n, replace=False))
        data = grams.pack(v)
        assert np.array_equal(grams.unpack(data), v) and len(data) <= grams.GROUP // 8
        some = rnd.integers(0, grams.GROUP, 500)
        assert np.array_equal(grams.has(data, some), np.isin(some, v))
        assert grams.has(data, v[:100]).all()


def test_stored_filter_is_that_of_the_rows_and_loses_no_shard(spark, built, texts):
    segs = built.segments()
    want = sorted(map(tuple, grams.ngram_filter_bits(segs).collect()))
    assert sorted(map(tuple, grams.unpacked(built._table("ngram")).collect())) == want
    rnd, of_shard = random.Random(2), {}
    for r in segs.collect():
        of_shard.setdefault(r["shard_id"], []).append(bytes(r["content"]))
    for n in (3, 7, 8, 9, 30, 60):
        t = rnd.choice([t for t in texts if len(t) > 500]).encode()
        needle = t[10 : 10 + n]
        got = {r[0] for r in built.candidate_shards([needle]).collect()}
        assert {s for s, parts in of_shard.items() if any(needle in p for p in parts)} <= got
        if n >= 30:
            assert len(got) < len(of_shard) / 2
    assert built.candidate_shards([b"\xff" * 20]).count() == 0


def test_bits_of_a_needle_are_enough_and_right():
    needles = [b"exactly8", b"a needle of some more bytes than eight", b"x" * 500]
    by_group = grams.wanted_bits(needles, 6)
    for i, n in enumerate(needles):
        mine = [np.split(bits, starts[1:])[k] + g for g, (number, _, starts, bits) in by_group.items() for k in np.flatnonzero(number == i)]
        every = np.unique(grams.bloom_pairs(n))
        assert np.isin(np.concatenate(mine), every).all() and len(np.concatenate(mine)) >= min(6, len(every))
        assert {int(need[number == i][0]) for number, need, _, _ in by_group.values() if (number == i).any()} == {len(mine)}


def test_many_candidate_shards_are_not_pushed_down(spark, built, texts, monkeypatch):
    monkeypatch.setattr(grams, "PUSHED", 1)
    t = next(t for t in texts if len(t) > 500)
    df = spark.createDataFrame([(i, bytearray(t[9 * i : 9 * i + 8].encode())) for i in range(40)] + [(99, bytearray(b"zzzzzzzzzz"))], "line_no bigint, needle binary")
    assert {r[0]: r[1] for r in built.batch_pruned(df).collect()} == {i: i < 40 for i in [*range(40), 99]}
    plan = grams.in_shards(built.segments(), spark.range(40).withColumnRenamed("id", "shard_id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    monkeypatch.setattr(grams, "BROADCAST_IDS", 1)
    assert {r[0] for r in built.batch_pruned(df).where("found").collect()} == set(range(40))
    assert built.contains_bytes(t[:3].encode()) and not built.contains_bytes(b"zzz")


@pytest.mark.parametrize("seed", range(12))
def test_stored_transform_against_brute_force(seed):
    rnd = random.Random(seed)
    parts = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 5))]
    last, c = bwt.transform(bwt.symbols(parts))
    marks = np.flatnonzero(last == bwt.MARK).astype(np.uint32)
    flat = np.where((last == bwt.END) | (last == bwt.MARK), 0, last.astype(np.int16) - 1).astype(np.uint8)
    shard = bwt.Stored(len(last), c, flat.tobytes(), int(np.flatnonzero(last == bwt.END)[0]), marks.tobytes(), 7, bwt.checkpoints(last, 7).tobytes())
    assert np.array_equal(shard.symbols(), last)
    for byte in (0, 97, 255):
        assert [shard.occ(byte, x) for x in range(len(last) + 1)] == [int((last[:x] == byte + 1).sum()) for x in range(len(last) + 1)]
    asked = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    want = [any(n in p for p in parts) for n in asked]
    assert [shard.contains(n) for n in asked] == want == shard.search(asked).tolist()


def test_counts_that_do_not_fit_are_an_error():
    assert bwt.narrow(np.array([0, 2**32 - 1])).dtype == np.uint32
    with pytest.raises(OverflowError):
        bwt.narrow(np.array([1, 2**32]))


@pytest.mark.parametrize("seed", range(40))
def test_skew_against_brute_force(seed):
    rnd = random.Random(seed)
    n, k = rnd.randint(1, 400), rnd.choice([1, 2, 3, 30])
    s = [rnd.randrange(k) for _ in range(n)] if seed % 2 else ([rnd.randrange(k) for _ in range(rnd.randint(1, 9))] * n)[:n]
    assert bwt.skew(np.array(s)).tolist() == sorted(range(n), key=lambda i: s[i:])


def test_texts_that_repeat_themselves_are_sorted_right():
    rnd = random.Random(1)
    line = bytes(rnd.choices(b"abcdef (){};\n", k=97))
    text = bwt.symbols([line * 60, line[:50] * 30, line * 3])
    raw = [int(x) for x in text]
    assert len(text) > 4096 and bwt.suffix_array(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_doubling_in_spark_agrees(spark):
    df = spark.createDataFrame([(1, b"banana\x00\xff"), (2, b""), (3, b"aaaaaaaaaaaaaaaaaaaa"), (4, None), (5, b"abababab")], "k bigint, content binary")
    assert sorted(map(tuple, bwt.suffix_doubling(df, "k").collect())) == sorted(map(tuple, bwt.suffix_rows(df, "k").collect()))


def test_needles_with_a_long_start_in_common(spark):
    lead = b"the same thirty leading bytes "
    bodies = [lead + b"%d and on" % i for i in range(50)]
    asked = [lead + b"%d" % i for i in range(0, 100)] + [lead, lead + b"7 and on", lead + b"7 and no"]
    df = spark.createDataFrame([(i, bytearray(n)) for i, n in enumerate(asked)], "line_no bigint, needle binary")
    want = {i: any(n in b for b in bodies) for i, n in enumerate(asked)}
    assert {r[0]: r[1] for r in search.batch_contains(corpus(spark, bodies), df).collect()} == want


def test_progress_tells_counts_bytes_and_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"f{i}").write_bytes(b"some words of a file " * 40)
    told = []
    m = build(spark, [str(tmp_path / "in")], f"file://{tmp_path}/out", BuildOptions(shard_size=900, max_query_bytes=20), told.append)
    by = {p: [x for x in told if x.phase == p and "tasks" not in x.message] for p in ("plan", "segments", "filters", "shards", "hash", "done")}
    for phase, events in by.items():
        assert events[-1].current == events[-1].total > 0 and events[-1].current_bytes == events[-1].total_bytes > 0, phase
    assert by["segments"][0].current == 0 and by["segments"][0].path.endswith("/f3") and by["hash"][-1].total_bytes == m.total_bytes
    index = open_index(spark, f"file://{tmp_path}/out")
    assert index.files().count() == 4 and sorted(map(tuple, index.shards().collect())) == sorted((s["shard_id"], s["file_count"], s["total_bytes"]) for s in m.shards)


def test_a_manifest_of_many_leaves_names_to_the_plan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "LISTED", 2)
    m = build_from(corpus(spark, [b"x" * 50] * 5), f"file://{tmp_path}/o", BuildOptions(shard_size=60, max_query_bytes=20, with_bwt=False, digest=False), None, ["somewhere"])
    assert m.shard_count == 5 and m.shards == [] == m.indexed_files and open_index(spark, f"file://{tmp_path}/o").shards().count() == 5


def test_shards_must_hold_what_was_planned(spark):
    plan = spark.createDataFrame([(0, 5), (0, 6), (1, 7)], "shard_id bigint, length bigint")
    ix._check_bytes(plan, plan)
    for bad in (plan.where("length <> 6"), plan.unionAll(plan.where("length = 7")), plan.where("shard_id = 0")):
        with pytest.raises(IndexFormatError):
            ix._check_bytes(plan, bad)


def test_single_index_whatever_the_size(spark, tmp_path):
    bodies = [b"abc" * 500, b"def" * 500]
    m = build_from(corpus(spark, bodies), f"file://{tmp_path}/one", BuildOptions(memory_limit=6400, max_query_bytes=8, single=True))
    index = open_index(spark, f"file://{tmp_path}/one")
    assert m.shard_count == 1 and index.max_query_bytes() == 0 and index.contains_bytes(b"abc" * 100) and not index.contains_bytes(b"cde")
    asked = spark.createDataFrame([(1, bytearray(b"def" * 300)), (2, bytearray(b"cdef"))], "line_no bigint, needle binary")
    assert {r[0]: r[1] for r in index.batch_backward(asked).collect()} == {1: True, 2: False}


def test_single_shard_is_written_by_many_tasks(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "PIECE", 500, raising=False)
    out = f"file://{tmp_path}/single"
    m = build_from(corpus(spark, [t.encode() for t in texts]), out, BuildOptions(max_query_bytes=60, single=True, digest=False))
    index = open_index(spark, out)
    sizes = [r[1] for r in index.segments().groupBy(F.input_file_name()).agg(F.sum("length")).collect()]
    assert m.shard_count == 1 and len(sizes) > 2 and sum(sizes) == sum(map(len, texts)) == m.total_bytes
    assert [tuple(r) for r in index.shards().collect()] == [(0, len(texts), m.total_bytes)]
    long = max(texts, key=len).encode()
    asked = [long, long + b"!", texts[-1].encode() + texts[0].encode()]
    asked = [n for n in asked if n]
    want = [any(n in t.encode() for t in texts) for n in asked]
    assert [index.contains_bytes(n) for n in asked] == want
    df = spark.createDataFrame([(i, bytearray(n)) for i, n in enumerate(asked)], "line_no bigint, needle binary")
    for way in (index.batch, index.batch_pruned, index.batch_backward):
        assert [r["found"] for r in way(df).orderBy("line_no").collect()] == want


def test_bits_at_once_are_those_byte_by_byte():
    rnd = np.random.default_rng(4)
    for n in (0, 7, 8, 9, 1000, grams.BLOCK + 6, grams.BLOCK + 7, grams.BLOCK + 8, 3 * grams.BLOCK):
        body = rnd.integers(0, 256, n, dtype=np.uint8)
        got = grams.bloom_values(body.tobytes())
        assert got.dtype == np.uint32 and len(got) == 2 * max(0, n - 7)
        for i in (0, len(got) // 4, len(got) // 2 - 1) if len(got) else ():
            a, c = bf._A0, bf._G
            for v in body[i : i + 8].tolist():
                a, c = ((a ^ v) * bf._FNV) % bf.BLOOM_BITS, (c ^ (v + bf._G + (c << 6) + (c >> 2))) & bf._C48
            assert (int(got[i]), int(got[len(got) // 2 + i])) == (a, (a + (c | 1)) % bf.BLOOM_BITS)


def test_totals_of_bits_make_no_row_of_a_bit(spark, built, texts, monkeypatch):
    segs = built.segments().unionByName(spark.createDataFrame([(900, bytearray(b"short"))], "shard_id bigint, content binary"), allowMissingColumns=True)
    monkeypatch.setattr(grams, "HELD", 300)
    got = grams.bit_totals(segs)
    want = grams.unpacked(grams.ngram_filter(segs)).groupBy("shard_id").agg(F.count("*"), F.sum("bit"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    plan = grams.bit_totals(segs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 1


def test_distinct_numbers():
    v = np.array([5, 1, 5, 3, 1], np.uint32)
    assert grams.distinct(v).tolist() == [1, 3, 5] and grams.distinct(v[:0]).tolist() == []


@pytest.mark.parametrize("most", [None, 40])
def test_probed_shards_are_those_of_the_rows(spark, built, texts, monkeypatch, most):
    rnd = random.Random(8)
    long = [t.encode() for t in texts if len(t) > 500]
    asked = [t[i : i + n] for n in (1, 2, 3, 5, 7, 8, 9, 30, 60) for t in rnd.sample(long, 3) for i in (rnd.randrange(400),)]
    asked += [asked[-1][:20] + b"#" + asked[-1][:20], b"", None, asked[-1], b"absent!!!!!"]
    df = spark.createDataFrame([(None if i == 2 else f"k{i % 11}", None if n is None else bytearray(n)) for i, n in enumerate(asked)], "k string, needle binary")
    segs = built.segments()
    if most:
        monkeypatch.setattr(search, "NEEDLE_BYTES", most)  # several passes
    for now, rows in ((grams.ngram_shards(segs, df, "k"), grams.ngram_candidates(grams.ngram_filter_bits(segs), df, "k")), (grams.trigram_shards(segs, df, "k"), grams.trigram_candidates(grams.trigram_index(segs), df, "k"))):
        got = sorted(map(repr, now.collect()))
        assert got == sorted(map(repr, rows.collect())) and len(got) > 10
    none = df.where("needle IS NULL")
    assert grams.ngram_shards(segs, none, "k").collect() == [] and grams.ngram_shards(segs, none, "k").columns == ["k", "shard_id"]


def test_which_looks_up_the_fewer():
    rnd = np.random.default_rng(5)
    for n, m in ((0, 5), (5, 0), (3, 90), (90, 3), (50, 50)):
        some, asked = (np.sort(rnd.choice(100, k, replace=False)) for k in (n, m))
        assert np.array_equal(grams._which(some, asked), np.isin(asked, some))


def test_index_has_the_digest_of_several_ranges(spark, texts, tmp_path, monkeypatch):
    import hashlib

    from needlebed.plans import manifest

    monkeypatch.setattr(manifest, "DIGEST_BYTES", 1000)
    read = []
    monkeypatch.setattr(type(spark.sparkContext), "runJob", lambda sc, rdd, f, parts, *a, run=type(spark.sparkContext).runJob: read.append(parts) or run(sc, rdd, f, parts, *a))
    m = build_from(corpus(spark, [t.encode() for t in texts]), f"file://{tmp_path}/index", BuildOptions(shard_size=600, max_query_bytes=60, with_bwt=False))
    assert m.sha256 == hashlib.sha256("".join(texts).encode()).hexdigest() and len(read) > 3
