"""Operator 4: sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def digits(text: Column) -> Column:
    """The first 32 bits of a text's MD5 as a number; any engine can tell it."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of ``key`` among ``shards``, with no table of the ring.

    The key's own random sequence r1, r2, ... decides: from shard b the next jump lands on
    floor((b + 1) / r), and the last landing below ``shards`` is the shard.  One more shard can only
    add a landing on itself.  Step i draws r from the digest of 'key:i', 32 bits, never 0; a null key is the empty text.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    name = F.coalesce(key.cast("string"), F.lit(""))
    draw = lambda i: (digits(F.concat(name, F.lit(":"), i.cast("string"))) + 1) / F.lit(float(1 << 32))

    def step(state: Column, i: Column) -> Column:
        land = F.floor((state["at"] + 1).cast("double") / draw(i)).cast("long")
        stop = F.struct(state["at"].alias("at"), F.lit(True).alias("over"))
        return F.when(state["over"], state).otherwise(F.when(land < shards, F.struct(land.alias("at"), F.lit(False).alias("over"))).otherwise(stop))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("over"))  # the first landing is always shard 0
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def jump_shards(docs: DataFrame, shards: int = 8, rows_a_group: int = 20_000) -> DataFrame:
    """Every document's shard and its slot there; law ``key``: doc_id and the shard count alone decide.

    ``slot`` counts a shard's rows from 0 without gaps: rows are ranked inside hashed groups and each
    group starts after the ones before it, so no shard gathers in one task.  The texts themselves are
    not shuffled.  Null doc_id is a key like any other; null text counts as empty; equal rows take
    different slots; an empty table gives an empty result.  Slots go by a digest of doc_id and text_crc32, whatever the number of groups.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        jump_hash(F.col("doc_id"), shards).alias("shard"), jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    groups = max(16, docs.count() // (rows_a_group * shards))
    name = F.concat_ws(":", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32")
    rows = rows.withColumn("order", digits(name)).withColumn("part", F.floor(F.col("order") * groups / (1 << 32)).cast("long"))  # ranges of the digest
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    skip = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(before, F.lit(0)).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("order", "doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("rank", rank).join(skip, ["shard", "part"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("rank") + F.col("skip")).cast("long").alias("slot"), "grown_shard")


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
