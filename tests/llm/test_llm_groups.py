"""Components, embeddings, and the pipeline, held against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from needlebed.llm import embed_dedup, minhash, queries
from needlebed.llm.graph import connected_components


def components(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    return {x: top(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops", "none"])
def test_components(spark, kind):
    rnd = random.Random(kind)
    edges = {
        "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)],
        "path": [(i + 1, i) for i in range(70)],
        "star": [(500, i) for i in range(60)] + [(500, 700)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
        "none": [],
    }[kind]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame([*edges, (None, 4)], "a bigint, b bigint")).collect()}
    want = components(e for e in edges if e[0] != e[1])
    assert got == want


def vectors(n, dim=32, copies=60, seed=1, noise=0.02):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim))
    near = x[rnd.integers(0, 20, copies)] + rnd.normal(size=(copies, dim)) * noise
    return np.concatenate([x, near]).astype(np.float32)


def test_embedding_groups_against_brute_force(spark):
    x = vectors(1500)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= embed_dedup.THRESHOLD, 1))
    want = {i: i for i in range(len(x))} | components(zip(a.tolist(), b.tolist()))
    rows = embed_dedup.embedding_groups(df).collect()
    assert {r["vec_id"]: r["group_id"] for r in rows} == want
    assert all(r["keep"] == (r["vec_id"] == r["group_id"]) for r in rows)


def test_embedding_recall_at_the_threshold(spark):
    """Pairs whose cosine is hardly over the threshold: the recall that the tables are made for."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(600, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rnd.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.952 * x + np.sqrt(1 - 0.952**2) * y
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]))], "vec_id bigint, embedding array<double>")
    groups = {r["vec_id"]: r["group_id"] for r in embed_dedup.embedding_groups(df).collect()}
    assert np.mean([groups[i] == groups[600 + i] for i in range(600)]) >= 0.9


def test_embedding_edges(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(1, a), (2, a), (2, a), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [float("nan"), 1.0, 1.0]), (None, a), (8, a + [0.0]), (9, b), (2, b)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("keep", F.lit("x"))
    got = sorted(((r[0], r[3], r[4]) for r in embed_dedup.embedding_groups(df).collect()), key=str)
    want = [(1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 8, True), (9, 1, False), (None, None, True)]
    assert got == sorted(want, key=str)
    assert embed_dedup.embedding_groups(df.limit(0)).count() == 0


def test_signature_length_follows_the_size():
    shapes = [embed_dedup.table_shape(n) for n in (0, 1, 500, 50_000, 5_000_000, 5_000_000_000)]
    assert [s[0] for s in shapes] == sorted(s[0] for s in shapes) and shapes[-1][0] >= 30
    for bits, tables in shapes:
        meets = (1 - np.arccos(embed_dedup.THRESHOLD) / np.pi) ** bits
        assert 1 - (1 - meets) ** tables >= embed_dedup.RECALL


def test_spanning_links_miss_nothing():
    x = vectors(80, 16, 60, 5, 0.3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = embed_dedup._links(np.arange(len(x)), x, 0.9)
    a, b = np.nonzero(np.triu(x.astype(np.float64) @ x.T.astype(np.float64) >= 0.9, 1))
    assert components(links) == components(zip(a.tolist(), b.tolist()))


def test_embedding_groups_in_parts(spark, monkeypatch):
    """Groups of more members than are compared at once, of which some are equal."""
    monkeypatch.setattr(embed_dedup, "TILE", 7)
    x = vectors(60, 24, 240, 9, 0.12)
    x = np.concatenate([x, 2 * x[:30]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= embed_dedup.THRESHOLD, 1))
    want = {i: i for i in range(len(x))} | components(zip(a.tolist(), b.tolist()))
    got = {r["vec_id"]: r["group_id"] for r in embed_dedup.embedding_groups(df, recall=0.9999).collect()}
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99
    assert all(got[i] == got[300 + i] for i in range(30))


def test_equal_vectors_enter_the_tables_once(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, float(i % 3)]) for i in range(300)], "vec_id bigint, embedding array<float>")
    rows, links = embed_dedup.near_links(df)
    assert rows.select("eid").distinct().count() == 3 and links.count() <= 2
    assert [r["group_id"] for r in embed_dedup.embedding_groups(df).orderBy("vec_id").collect()][:3] == [0, 1, 1]


def test_signs_leave_pairs_at_the_threshold():
    rnd = np.random.default_rng(2)
    for t in (0.8, 0.95, 0.99):
        p = np.arccos(t) / np.pi
        assert (rnd.binomial(embed_dedup.SIGNS, p, 200_000) > embed_dedup.most_apart(t)).mean() < 3e-4


WORDS = [f"w{i}x" for i in range(500)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, rnd = str(tmp_path_factory.mktemp("tables")), random.Random(4)
    texts = [" ".join(rnd.choices(WORDS, k=30 + i % 40)) for i in range(300)]
    texts += texts[:20] + [t + " more" for t in texts[20:40]] + ["BAD!! " * 20 + str(i) for i in range(30)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 340), 0) for i in range(0, 370, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_against_brute_force(spark, tables):
    docs, kept = spark.read.parquet(f"{tables}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        out = stage(spark, docs, tables)
        path = f"{tables}/stage-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        assert set(kept[name]) <= set(before)
        if name != "encode":
            assert docs.columns == columns and all(kept[name][i] == before[i] for i in kept[name])
    assert set(kept["quality"]) == set(range(340))
    assert set(kept["exact_dedup"]) == set(range(300)) | set(range(320, 340))
    assert set(kept["near_dedup"]) == set(range(300))
    tokens = {s: sum(len(r["text"].split()) for r in kept["mix"].values() if r["source"] == s) for s in ("src0", "src1", "src2")}
    assert tokens["src0"] / tokens["src1"] == pytest.approx(4 / 1.5, rel=0.01) and tokens["src1"] / tokens["src2"] == pytest.approx(3, rel=0.01)
    assert set(kept["encode"]) == set(kept["mix"]) and all(r["round_trip"] for r in kept["encode"].values())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, tables).collect()) == sorted(kept["encode"])


def test_every_query_of_this_folder_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert minhash.THRESHOLD == 0.5 and len(corpus_pipeline.STAGES) == 5
