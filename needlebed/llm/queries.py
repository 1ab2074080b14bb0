"""The queries of this subpackage, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlebed.llm import bpe, embed_dedup, html_extract, lm, minhash, mixing, quality, warc
from needlebed.llm import exact_dedup as ed
from needlebed.llm import sharding as sh
from needlebed.llm.common import work_path


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Parts of the mix by source; sources that aren't named have 1.
MIX = {"src0": 4.0, "src1": 1.5, "src2": 0.5}
#: The part of all tokens that the mix has at least, whatever the scarcest source holds.
MIX_SHARE = 0.45


def op1_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_t(spark, d, "documents"), MIX, tokens_out="n_tokens", share=MIX_SHARE).select("doc_id", "source", "n_tokens")


def op2_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = ed.exact_dedup(_t(spark, d, "documents"))
    return kept.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


OP2 = """
SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL
"""


def op3_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_dedup(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id")


def op4_warc(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "warc")
    index = warc.normalise(warc.write_monolithic(_t(spark, d, "pages"), path + "/whole"), path + "/members")
    got = warc.read_records(index)
    return got.select(F.regexp_extract("record_id", r"(-?\d+)$", 1).cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), F.octet_length("block").cast("bigint").alias("n_bytes"), F.sha2("block", 256).alias("sha256"))


OP4 = "SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL"


def op5_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract_text(_t(spark, d, "pages")).select("page_id", "url", "text")


def op6_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return lm.score_lm(docs, lm.train_lm(docs))


def op7_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    kept = quality.quality_filter(_t(spark, d, "documents").select("doc_id", "text"), _t(spark, d, "labels"), out_col="quality_score")
    return kept.select("doc_id", "quality_score")


def op8_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.bpe_encode(_t(spark, d, "documents").select("doc_id", "text"))


def op10_embedding_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embed_dedup.embedding_groups(_t(spark, d, "embeddings")).select("vec_id", "group_id", "keep")


OP10 = f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding, b.embedding) >= {embed_dedup.THRESHOLD}),
r AS (SELECT vec_id AS node, vec_id AS to_node FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON r.to_node = e.a)
SELECT node AS vec_id, min(to_node) AS group_id, min(to_node) = node AS keep FROM r GROUP BY node
"""


def op9_sharding(spark: SparkSession, d: str) -> DataFrame:
    docs, path = _t(spark, d, "documents"), work_path(spark, "slot-map")
    load = sh.slot_bytes(docs)
    sh.save_map(sh.initial_map(spark), path, 1)
    sh.save_map(sh.rebalance(sh.load_map(spark, path), load), path, 2)
    new = sh.load_map(spark, path)
    return sh.assign(docs, new).join(F.broadcast(new.select("slot", "moved")), "slot").select("doc_id", "slot", "shard", "moved")


OP9 = f"""
WITH d AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {sh.SLOTS} AS INTEGER) AS slot, coalesce(octet_length(encode(text)), 0) AS size FROM documents),
l AS (SELECT CAST(r AS INTEGER) AS slot, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM range({sh.SLOTS}) t(r) LEFT JOIN d ON d.slot = r GROUP BY r),
a AS (SELECT slot, CAST(slot * {sh.SHARDS} // {sh.SLOTS} AS INTEGER) AS shard, bytes, CAST(ceil(CAST((SELECT sum(bytes) FROM l) AS DOUBLE) / {sh.SHARDS} * {1 + sh.TOLERANCE}) AS BIGINT) AS cap FROM l),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY slot) <= cap AS stays FROM a),
h AS (SELECT r.shard, any_value(cap) - coalesce(sum(bytes) FILTER (stays), 0) AS room FROM (SELECT CAST(i AS INTEGER) AS shard FROM range({sh.SHARDS}) t(i)) r LEFT JOIN s USING (shard) GROUP BY r.shard),
e AS (SELECT shard, sum(room) OVER (ORDER BY shard) AS upto, sum(room) OVER (ORDER BY shard) - room AS start FROM h),
m AS (SELECT slot, sum(bytes) OVER (ORDER BY bytes DESC, slot) - bytes // 2 AS mid FROM s WHERE NOT stays),
p AS (SELECT slot, coalesce(e.shard, {sh.SHARDS - 1}) AS shard, true AS moved FROM m LEFT JOIN e ON mid >= start AND mid < upto UNION ALL SELECT slot, shard, false FROM s WHERE stays)
SELECT doc_id, slot, CAST(shard AS INTEGER) AS shard, moved FROM d JOIN p USING (slot)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_warc": op4_warc,
    "op5_html_extraction": op5_html_extraction,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe": op8_bpe,
    "op9_sharding": op9_sharding,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2,
    "op4_warc": OP4,
    "op5_html_extraction": html_extract.oracle(),
    "op9_sharding": OP9,
    "op10_embedding_near_dedup": OP10,
}
