"""Sharding over fixed virtual slots: a record's slot never changes, only the slot's shard does.

A record is hashed into one of thousands of slots. The bytes of each slot are summed, and a map from slot to shard is
stored under a version. Rebalancing edits that map: a shard keeps its slots, in the order of their numbers, as far as
its capacity goes; only the rest move, into what room the other shards have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from needlebed.llm.common import cut, fresh, need

SLOTS, SHARDS, TOLERANCE = 4096, 16, 0.02


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its MD5, modulo ``slots``. A null key counts as the empty string."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % slots).cast("int")


def slot_bytes(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, records) of every slot, those without records too. A null or empty text has 0
    bytes, one of any length all of its bytes, UTF-8 or not. Repeated rows count each; a null key counts as the empty
    string. An empty table gives 0 for every slot. Other columns, whatever their names, aren't read."""
    need(docs, key_col, text_col)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    used = docs.select(slot_of(F.col(key_col), slots).alias("slot"), size.alias("size")).groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))
    every = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(used, "slot", "left").fillna(0, ["bytes", "records"])


def initial_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: equal ranges of slots."""
    return spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard"), F.lit(False).alias("moved"))


def rebalance(slot_map: DataFrame, load: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(slot, shard, moved): ``slot_map`` edited so that no shard holds much more than its part of ``load``.

    The capacity of a shard is the mean load times 1 + ``tolerance``, rounded up. A shard keeps slots in their order
    while their running sum stays within it; slots of shards numbered ``shards`` or more all move. The rooms that
    are left lie in a row, in the order of the shards, and the moving slots, largest first, are laid along that row:
    a slot goes to the shard in whose room its middle falls. A shard can so exceed its capacity by less than one
    slot. With no bytes at all nothing moves except away from shards that are gone. The tables have one row for each slot or
    shard, thousands whatever the data; the two windows over them all are as small.
    """
    at = slot_map.join(load.select("slot", "bytes"), "slot", "left").fillna(0, ["bytes"])
    cap = F.ceil(F.sum("bytes").over(Window.partitionBy()) / F.lit(shards) * F.lit(1 + tolerance)).cast("bigint")
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy("slot"))
    at = cut(at.withColumn("cap", cap).withColumn("stays", (F.col("shard") < shards) & (run <= F.col("cap"))))
    every = at.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    room = every.join(at.where("stays").groupBy("shard").agg(F.sum("bytes").alias("held")), "shard", "left").crossJoin(at.agg(F.max("cap").alias("cap")))
    room = room.select("shard", (F.col("cap") - F.coalesce("held", F.lit(0))).alias("room"))
    room = room.withColumn("upto", F.sum("room").over(Window.orderBy("shard"))).withColumn("from", F.col("upto") - F.col("room"))
    move = at.where(~F.col("stays")).withColumn("mid", F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "slot")) - F.floor(F.col("bytes") / 2).cast("bigint"))
    last = room.agg(F.max("upto").alias("all"), F.max("shard").alias("last"))
    put = move.crossJoin(F.broadcast(last)).join(F.broadcast(room.withColumnRenamed("shard", "to")), (F.col("mid") >= F.col("from")) & (F.col("mid") < F.col("upto")), "left")
    put = put.select("slot", F.coalesce("to", "last").alias("shard"), F.lit(True).alias("moved"))
    return at.where("stays").select("slot", "shard", F.lit(False).alias("moved")).unionAll(put)


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Write a version of the map; versions are never changed once written."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={int(version)}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of ``version``, by default the newest."""
    every = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/version=*")
    version = version if version is not None else every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).drop("version")


def assign(docs: DataFrame, slot_map: DataFrame, key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with its slot and shard in two more columns, ``slot`` and ``shard`` (with underscores in front where
    ``docs`` has such columns). Every row gets a shard, rows with a null key as well, repeated rows each; equal keys
    share a shard. The map has one row for each slot, so it is broadcast whatever the size of ``docs``."""
    need(docs, key_col)
    slot, shard = fresh(docs, "slot", "shard")
    small = F.broadcast(slot_map.select(F.col("slot").alias(slot), F.col("shard").alias(shard)))
    return docs.withColumn(slot, slot_of(F.col(key_col), slots)).join(small, slot).select(*docs.columns, slot, shard)
