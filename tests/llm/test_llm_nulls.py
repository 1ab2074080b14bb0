"""Every stage over rows with nulls in any column, very long and empty texts, repeated rows, clashing names, and none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from needlebed.llm import embed_dedup, html_extract, lm, sharding, warc

LONG = "long words " * 60_000
ROWS = [
    (None, None, None, None, None), (1, None, "en", "a", None), (None, "some text here", None, None, 3), (2, "", "en", "a", 0), (2, "", "en", "a", 0),
    (3, LONG, "en", None, len(LONG)), (4, "x" * 400_000, None, "b", 1), (5, "repeated row of words", "en", "b", 21), (5, "repeated row of words", "en", "b", 21), (6, "repeated row of words", None, "b", 21),
]
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["slot", "shard", "mix_source", "mix_edge", "bpe_bytes", "perplexity", "size", "digest", "id_key", "RN", "mix_src", "n_tokens", "quality_score", "near_key", "near_th", "eid", "sketch", "tokens", "c", "n", "part", "take"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nulls"))
    spark.createDataFrame([(1, None, 0), (None, 1, 1), (2, 1, None), (5, 1, 0), (3, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, KIND)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.mark.parametrize("name", [s[0] for s in corpus_pipeline.STAGES])
def test_stage(spark, folder, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs(spark), folder)
    out.write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    if name == "encode":
        assert len(got) == len(ROWS) and {r["round_trip"] for r in got} == {None, True}
        return
    assert out.columns == docs(spark).columns
    if name == "exact_dedup":
        assert ids == sorted([None, None, 1, 2, 3, 4, 5], key=str)
    if name == "near_dedup":
        assert ids == sorted([None, None, 1, 2, 2, 3, 4, 5], key=str)
    if name == "mix":
        assert all((r["text"] or "").strip() for r in got)
    assert all(r["c"] == CLASH.index("c") for r in got)


@pytest.mark.parametrize("name", [s[0] for s in corpus_pipeline.STAGES])
def test_stage_without_rows(spark, folder, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs(spark, []), folder).count() == 0


def test_whole_pipeline_on_such_rows(spark, folder, tmp_path):
    spark.createDataFrame(ROWS, KIND).write.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = [r for r in corpus_pipeline.quality(spark, spark.createDataFrame(ROWS, KIND), folder).collect() if (r["text"] or "").strip()]
    firsts = {}
    for r in sorted(kept, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        firsts.setdefault(" ".join(r["text"].split()), r)
    assert len(firsts) > 1 and {(r["doc_id"], r["source"]) for r in rows} <= {(r["doc_id"], r["source"]) for r in firsts.values()}
    lengths = [len(t.split()) for t in firsts]
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
    # No source has to give all but by its own part, and the longest document is more than the share of all.
    text = {r["doc_id"]: r["text"] for r in firsts.values()}
    assert sum(len(text[r["doc_id"]].split()) for r in rows) <= max(0.45 * sum(lengths), sum(sorted(lengths)[:-1]))
    assert all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) > 0 for r in rows)


def test_bytes_that_are_no_text(spark, folder, tmp_path):
    """Every operator takes a string column whose bytes aren't UTF-8; what can return the bytes returns them as they are."""
    bad = F.when(F.col("doc_id") == 5, F.expr("cast(unhex('61ff6220fe6320') as string)")).otherwise(F.col("text"))
    df = docs(spark).withColumn("text", bad)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, folder).write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert {r["round_trip"] for r in read("encode").where("doc_id = 5").collect()} == {False}
    for name in ("exact_dedup", "near_dedup"):
        assert [r[0] for r in read(name).where("doc_id = 5").select(F.hex(F.col("text").cast("binary"))).collect()] == ["61FF6220FE6320"]
    assert len(set(lm.score_lm(df, lm.train_lm(df)).where("doc_id = 5").select("log_prob").collect())) == 1
    assert {r[0] for r in read("mix").where("doc_id = 5").select(F.hex(F.col("text").cast("binary"))).collect()} <= {"61FF6220FE6320"}
    assert sharding.slot_bytes(df.where("doc_id = 5")).agg(F.sum("bytes")).first()[0] == 14
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "text", F.repeat(F.lit(" word"), 40)).alias("html")).where("page_id = 5")
    assert {r["text"] for r in html_extract.extract_text(pages).collect()} == {"a\ufffdb \ufffdc " + " ".join(["word"] * 40)}


def test_other_operators(spark, tmp_path):
    df = docs(spark)
    scored = lm.score_lm(df, lm.train_lm(df)).collect()
    assert len(scored) == len(ROWS) and sum(r["_perplexity"] is None for r in scored) == 4
    assert sharding.assign(df, sharding.initial_map(spark)).count() == len(ROWS)
    assert sharding.slot_bytes(df).agg(F.sum("records")).first()[0] == len(ROWS)
    pages = spark.createDataFrame([(None, None, None), (1, None, ""), (1, "u", "<p>" + LONG), (1, "u", "<p>" + LONG)], "page_id bigint, url string, html string")
    assert [r["text"] is None for r in html_extract.extract_text(pages).collect()] == [True, False, False, False]
    index = warc.normalise(warc.write_monolithic(pages, f"file://{tmp_path}/w"), f"file://{tmp_path}/m")
    assert sorted(len(r["block"]) for r in warc.read_records(index).collect()) == [0, len(LONG) + 3, len(LONG) + 3]
    none = pages.limit(0)
    assert html_extract.extract_text(none).count() == 0 and lm.score_lm(df.limit(0), lm.train_lm(df.limit(0))).count() == 0
    assert warc.read_records(warc.normalise(warc.write_monolithic(none, f"file://{tmp_path}/w0"), f"file://{tmp_path}/m0")).count() == 0
    vectors = spark.createDataFrame([(None, None, None), (1, None, 1), (1, [1.0], None)], "vec_id bigint, embedding array<float>, label int")
    assert embed_dedup.embedding_groups(vectors).count() == 3
