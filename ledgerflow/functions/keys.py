"""Key hash and shard index, equal to the hash of a byte array on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(key: Column) -> Column:
    """null: 0; else start at 1 and take 31 * h + signed byte for each byte, in 32-bit arithmetic."""
    #: In this charset each byte is the character of the same number.
    text = F.decode(key, "ISO-8859-1")
    bytes_ = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint"))
    folded = F.aggregate(F.when(F.length(key) > 0, bytes_).otherwise(F.array().cast("array<bigint>")), F.lit(1).cast("bigint"), lambda a, b: (a * 31 + F.when(b > 127, b - 256).otherwise(b)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(key.isNull(), F.lit(0).cast("bigint")).otherwise(F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded))


def shard_index(key: Column, shards: int) -> Column:
    return F.pmod(key_hash(key), F.lit(shards)).cast("int")
