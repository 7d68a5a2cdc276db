"""Rendezvous hashing: each record key goes to the shard that draws the best ticket for it.

A shard's ticket is -ln(u) / weight, with u uniform in (0, 1] from a hash of the key and the shard's number; the smallest
wins. Shares are then as the weights, and a further shard takes exactly the records for which it draws the best ticket:
no record moves between the shards that were there before. Columns only; one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiqal.llm._prefix import running

#: Buckets over which the records of one shard are numbered.
BUCKETS = 1024


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number (from 0) of the shard of a key. Equal keys share a shard, and so do null keys; weight 0 gets nothing.

    Keys are hashed as text, so 7 has one shard whether it is an int, a bigint or a string.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("a shard needs a weight above 0")
    tickets = []
    for s, w in enumerate(weights):
        if w > 0:
            u = (F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(s)), 11) + 1) / float(1 << 53)
            tickets.append(F.struct((-F.log(u) / float(w)).alias("ticket"), F.lit(s).alias("shard")))
    return (F.least(*tickets) if len(tickets) > 1 else tickets[0])["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of each row, as column `name` (replacing one of that name). Null and repeated keys: see shard_of."""
    return docs.withColumn(name, shard_of(docs[key_col], weights))


def numbered(docs: DataFrame, shards: int = 24, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, for equal weights.

    size: UTF-8 bytes of the text plus 8. slot: the row's number in its shard, without gaps, in an order that only keys and
    texts decide. grown_shard: its shard with one more. Null text: no bytes, crc32 0. Rows that agree in key and text take
    neighbouring slots.
    """
    text = docs[text_col].cast("string")
    key = docs[key_col]
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = rows.select("*", F.lit("key").alias("law"), shard_of(F.col("doc_id"), [1.0] * shards).alias("shard"), shard_of(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BUCKETS)).alias("bucket"))
    out = running(rows, "shard", "bucket", ["doc_id", "text_crc32", "size"], F.lit(1))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("before").cast("long").alias("slot"), "grown_shard")
