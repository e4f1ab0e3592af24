"""A bitmap of hashed keys that tells which rows cannot be among them.

Bits are set by ``bitmap_construct_agg``, 32,768 to a bitmap, and bitmaps are broadcast: their
number follows from that of the keys, up to ``MOST_BITS`` bits. A row whose bit is not set is
none of the keys for sure; of the other rows some are set by chance, about one in ``BITS_EACH``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS_EACH = 16
BITMAP = 1 << 15
#: 32 MB, the most that is broadcast. Beyond sixteen million keys more rows are set by chance.
MOST_BITS = 1 << 28


def bits_for(keys: int) -> int:
    """A power of two with ``BITS_EACH`` bits for each key, and at least one bitmap."""
    return min(MOST_BITS, max(BITMAP, 1 << max(keys * BITS_EACH - 1, 1).bit_length()))


def bitmaps(keys: DataFrame, hash_: Column, bits: int) -> DataFrame:
    """``_bitmap, _bits``: one row per bitmap with a bit set, 4 KB each."""
    at = F.pmod(hash_, F.lit(bits))
    return keys.select(F.floor(at / BITMAP).alias("_bitmap"), F.pmod(at, F.lit(BITMAP)).alias("_at")).groupBy("_bitmap").agg(
        F.bitmap_construct_agg("_at").alias("_bits"))


def with_may_hold(df: DataFrame, made: DataFrame, hash_: Column, bits: int, name: str) -> DataFrame:
    """Adds whether a row's bit is set. No row moves: the bitmaps come to the rows."""
    at = F.pmod(hash_, F.lit(bits))
    met = df.withColumn("_at", F.pmod(at, F.lit(BITMAP))).withColumn("_bitmap", F.floor(at / BITMAP))
    met = met.join(F.broadcast(made), "_bitmap", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)) % 2
    return met.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_at", "_bitmap", "_bits")
