"""Needles of any number and length."""

import random

import pytest

from needlebed.operators import bwt, grams
from needlebed.plans import queries
from needlebed.plans.index import BuildOptions, build_from, open_index
from needlebed.sources.tables import from_table


def test_backward_search_in_several_passes(spark, tmp_path):
    texts = [f"document {i} holds the number {i * i} and more" for i in range(60)]
    docs = from_table(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text")
    build_from(docs, f"{tmp_path}/index", BuildOptions(shard_size=512, max_query_bytes=64))
    index = open_index(spark, f"{tmp_path}/index")
    needles = [f"number {i}".encode() for i in range(300)] + [None, b"", b"x" * 500, b"number 4"]
    q = spark.createDataFrame([(i, bytearray(n) if n is not None else None) for i, n in enumerate(needles)], "line_no bigint, needle binary")
    want = {i: bool(n) and any(n in t.encode() for t in texts) for i, n in enumerate(needles)}
    assert {r[0]: r[1] for r in bwt.backward_search(index._table("bwt"), q, max_needle_bytes=200).collect()} == want
    assert {r[0]: r[1] for r in bwt.backward_search(index._table("bwt"), q.where("line_no > 300 AND line_no < 302"), max_needle_bytes=200).collect()} == {301: False}
    assert {r[0]: r[1] for r in index.batch_backward(q).collect()} == want


def test_needles_shorter_than_a_gram_and_longer_than_the_overlap(spark, tmp_path):
    rnd = random.Random(5)
    text = "".join(rnd.choices("abcdefgh", k=150_000))
    needles = ["a", "ab", text[500:504], text[900:907], "zz", "z", "abczzzz", text[64_000:67_000], text[64_000:67_000] + "z", text[64_900:65_600], "", None]
    spark.createDataFrame([(1, text), (2, "b")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(needles)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i: bool(n) and n in text for i, n in enumerate(needles)}
    for query in (queries.raw_verify, queries.backward_search):
        assert {r["item_id"]: r["found"] for r in query(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("query", [queries.raw_verify, queries.sharded_contains])
def test_routes_store_no_filter_for_one_search(spark, tmp_path, monkeypatch, query):
    rnd = random.Random(6)
    text = "".join(rnd.choices("abcdefgh", k=90_000))
    needles = ["a", text[700:705], "abcz", text[64_000:64_900], text[64_000:64_030] + "z", text[66_000:66_008], "", None]
    spark.createDataFrame([(1, text), (2, "b")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(needles)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("ngram_filter", "trigram_index"):
        monkeypatch.setattr(grams, name, None)
    assert {r["item_id"]: r["found"] for r in query(spark, str(tmp_path)).collect()} == {i: bool(n) and n in text for i, n in enumerate(needles)}
