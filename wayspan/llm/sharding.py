"""Sharding by jump consistent hashing.

A stable key and the number of shards decide the shard; no table of the ring is kept. When shards are
appended, a key either stays or moves into one of the new shards, and only the necessary fraction moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayspan.llm.common import unused_name

#: Sub-buckets of a shard in which slots are numbered on their own before offsets are added.
SLOT_BUCKETS = 256


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys, all rows together: the expected number of rounds is ln(shards) + 1."""
    key = keys.astype(np.uint64).copy()
    bucket = np.full(len(key), -1, np.int64)
    ahead = np.zeros(len(key), np.int64)
    active = np.arange(len(key))
    while len(active):
        bucket[active] = ahead[active]
        key[active] = key[active] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[active] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[active] = ((bucket[active] + 1) * step).astype(np.int64)
        active = active[ahead[active] < shards]
    return bucket.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key column, 0 to shards - 1. Null keys must be replaced before."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    return shard(key)


def stable_key(column: Column) -> Column:
    """64-bit key of any column; null is a key of its own."""
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("\x00null")))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", grown: int | None = None) -> DataFrame:
    """Adds `shard`, `grown_shard` (with `grown` shards, one more by default) and the gapless `slot` of each
    row in its shard.

    Null keys share one shard; rows that repeat a key share its shard and get slots of their own; null and
    empty texts have a size of 1; an empty table gives an empty one. Columns of the input that have one of
    the new names go on under that name with an underscore behind it. Slots need no shard in one task: rows are numbered within sub-buckets
    (hashed, so a hot shard or key order doesn't matter) and the counts of the sub-buckets, at most
    shards x SLOT_BUCKETS rows, are summed up to offsets.
    """
    grown = shards + 1 if grown is None else grown
    for name in ("shard", "grown_shard", "slot", "_key", "_sub", "_at", "_before"):
        if name in df.columns:
            df = df.withColumnRenamed(name, unused_name(df, f"{name}_"))
    placed = df.withColumn("_key", stable_key(F.col(key)))
    placed = placed.withColumn("shard", jump_shard(F.col("_key"), shards)).withColumn("grown_shard", jump_shard(F.col("_key"), grown))
    salt = F.xxhash64(F.col("_key"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(-1)))
    placed = placed.withColumn("_sub", F.pmod(salt, F.lit(SLOT_BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard"), F.col("_sub"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_sub").orderBy("_key", F.col(key).asc_nulls_first())
    numbered = placed.withColumn("_at", F.row_number().over(within))
    # shards x SLOT_BUCKETS rows at most, whatever the input: a proven bound
    out = numbered.join(F.broadcast(offsets), ["shard", "_sub"])
    return out.withColumn("slot", (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_key", "_sub", "_at", "_before")


def op5_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by key; `grown_shard` is the shard with 17."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = assign_shards(sized.withColumn("text", F.col("text_crc32").cast("string")), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
