"""A corpus pipeline: STAGES in order over the documents of a folder of tables, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from needlebed.llm.bpe import bpe_encode
from needlebed.llm.common import work_path
from needlebed.llm.exact_dedup import exact_dedup
from needlebed.llm.minhash import near_dedup
from needlebed.llm.mixing import mix_sources
from needlebed.llm.quality import quality_filter
from needlebed.llm.queries import MIX, MIX_SHARE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, rejects go. Nulls, empty, very long and repeated texts and tables without rows
    are as ``quality_filter`` and ``score_quality`` say; ties at the threshold stay."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the smallest id; what nulls, repeated rows and clashing names give is in
    ``exact_dedup``."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; nulls, texts without words, ties and repeated rows are as
    ``near_dedup`` says."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A part of all tokens, of each source as many as its weight gives it, or all if it has less. Texts
    without tokens go; null sources, ties and repeated rows are as ``mix_sources`` says."""
    return mix_sources(docs, MIX, share=MIX_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens take the place of the text; a null text has null tokens, an empty one none, as ``bpe_encode`` says."""
    return bpe_encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix", mix),
    ("encode", encode),
]

#: A trained classifier, sketches and byte-pair merges aren't SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written to the shared folder, and the next one reads that."""
    path = work_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{i}-{name}")
        docs = spark.read.parquet(f"{path}/{i}-{name}")
    return docs
