"""Exact dedup against a persistent index of digests, bucketed and sorted by digest.

New rows are reduced to one per digest, the digests that the index has already are taken away by a sort-merge
anti-join that reads the index bucket by bucket without a shuffle, and the rest are appended.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from needlebed.llm.common import fresh, id_key, need, work_path


class DigestIndex:
    """Digests seen so far, under ``path``: ``data`` holds (digest BINARY, id_key STRING, batch STRING) in parts, bucketed
    and sorted by digest; ``log/<n>`` says which parts count and in which part each batch is.

    Only what the newest log entry names is ever read, so a part that a lost driver left half written is nothing, and
    the batch is written anew when it is run again. ``buckets`` counts when the index is made; an existing index keeps
    its own. Choose it so that a bucket fits a task: some 64 bytes a document, so 10 000 buckets for 10^10 documents.
    One writer at a time; a second one fails at the log entry that the first has written.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "digest_index_" + re.sub(r"\W", "_", uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex)
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._version() is None:
            self._log(0, {"buckets": int(buckets), "batches": {}})
        self.buckets = self._state()["buckets"]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, id_key STRING, batch STRING, part STRING) USING parquet "
            f"PARTITIONED BY (part) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
        )
        if self.fs.exists(self._at("data")):
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _version(self) -> int | None:
        """The number of the newest log entry."""
        log = self._at("log")
        names = [f.getPath().getName() for f in self.fs.listStatus(log)] if self.fs.exists(log) else []
        return max((int(n) for n in names if n.isdigit()), default=None)

    def _state(self) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/log/{self._version()}").collect()))

    def _log(self, version: int, state: dict) -> None:
        """A log entry, whole or not at all: written under another name, renamed where there is none of that number."""
        whole, part = self._at(f"log/{version}"), self._at(f"log/part-{uuid.uuid4().hex}")
        out = self.fs.create(part)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.fs.exists(whole) or not self.fs.rename(part, whole):
            self.fs.delete(part, False)
            raise RuntimeError(f"{self.path}: another writer has made log entry {version}")

    def _rows(self, state: dict, batch: str | None = None) -> DataFrame:
        parts = [state["batches"][batch]] if batch else sorted(set(state["batches"].values()))
        rows = self.spark.table(self.name).where(F.col("part").isin(parts) if parts else F.lit(False))
        return rows.where(F.col("batch") == batch) if batch else rows

    def rows(self) -> DataFrame:
        """(digest, id_key, batch) of all batches that are whole."""
        return self._rows(self._state()).select("digest", "id_key", "batch")

    def _write(self, rows: DataFrame, version: int, state: dict, batches: list[str]) -> None:
        part = uuid.uuid4().hex
        rows = rows.select("digest", "id_key", "batch").repartition(self.buckets, "digest").withColumn("part", F.lit(part))
        rows.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        self._log(version + 1, state | {"batches": state["batches"] | dict.fromkeys(batches, part)})

    def append_new(self, candidates: DataFrame, batch: str) -> DataFrame:
        """Append those (digest, id_key) whose digest is new, as ``batch``; return what the batch holds.

        A batch that is there already is left alone: running it again gives the same result. One whose run broke off
        isn't there, whatever it has written.
        """
        version, state = self._version(), self._state()
        if batch not in state["batches"]:
            new = candidates.join(self._rows(state).select("digest").hint("merge"), "digest", "left_anti")
            self._write(new.withColumn("batch", F.lit(batch)), version, state, [batch])
            state = self._state()
        return self._rows(state, batch).select("digest", "id_key")

    def compact(self) -> None:
        """Put all batches into one part, a sorted file for each bucket, so that a join needs no sort of the index.
        Parts that no longer count stay where they are until they are deleted from outside, for readers under way."""
        version, state = self._version(), self._state()
        if len(set(state["batches"].values())) > 1:
            self._write(self._rows(state), version, state, list(state["batches"]))


def text_digest(text: str = "text"):
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is new, one for each text, with the columns of ``docs``.

    Of rows with equal text the one with the smallest ``id_col`` stays; of rows with equal text and equal id, any one
    (the first in the order of the other columns cast to string). Null ids come after all others. A null text has no
    content to compare: such rows all stay and don't enter the index. The empty text is a text like any other, and so
    is a very long one, of which only the digest is compared; bytes that aren't UTF-8 are compared as they are. An
    empty table gives an empty table. Columns of ``docs`` named like our own are kept apart and come back unchanged.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    index = index or DigestIndex(spark, work_path(spark, "digest-index"))
    dig, key, rn = fresh(docs, "digest", "id_key", "rn")
    full = docs.where(F.col(text_col).isNotNull()).withColumn(dig, text_digest(text_col)).withColumn(key, id_key(F.col(id_col)))
    first = full.groupBy(F.col(dig).alias("digest")).agg(F.min(id_col).alias("id")).select("digest", id_key(F.col("id")).alias("id_key"))
    won = index.append_new(first, batch or uuid.uuid4().hex).select(F.col("digest").alias(dig), F.col("id_key").alias(key))
    # Both keys: the copies of a text that has thousands go to as many tasks.
    kept = full.join(won, [dig, key])
    others = [F.col(c).cast("string") for c in docs.columns if c not in (id_col, text_col)]
    one = Window.partitionBy(dig, key).orderBy(*(others or [F.col(key)]))
    kept = kept.withColumn(rn, F.row_number().over(one)).where(F.col(rn) == 1).select(*docs.columns)
    return kept.unionAll(docs.where(F.col(text_col).isNull()))
