"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots inside each shard.

A record goes to the shard with the greatest score -weight / ln(u), u uniform from a hash of key and
shard. One more shard can only win records for itself. Slots are counted in buckets of a shard, so no
window holds a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents


def _uniform(key: Column, salt: int) -> Column:
    """(0, 1) from the upper 53 bits of the XXH64 of key and salt."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of a string key. Ties in the score go to the smaller shard number."""
    scores = [F.struct((F.lit(-float(w)) / F.log(_uniform(key, i))).alias("score"), F.lit(-i).alias("minus")) for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*scores))["minus"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", grown: Sequence[float] | None = None, buckets: int = 256) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    size is the UTF-8 length plus 8; a null text has no bytes (crc32 0). A null doc_id is the key 'null'.
    Rows with equal doc_ids go to one shard; ties in slot order fall to crc32, then size. Shards of weight
    0 get nothing. grown: weights with more shards, for grown_shard; null where not given.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    rows = rows.select("*", rendezvous(F.col("key"), weights).alias("shard"), (rendezvous(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), F.floor(_uniform(F.col("key"), -1) * buckets).cast("int").alias("bucket"))
    totals = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumn("n", F.row_number().over(inside)).join(totals, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")


SHARDS = 24


def op6_rendezvous(spark, sf_dir: str) -> DataFrame:
    """Query op6: all documents into shards 0 to 23 of equal weight; grown_shard with one more."""
    return assign(documents(spark, sf_dir), [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))

