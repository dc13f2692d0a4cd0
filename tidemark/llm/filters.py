"""Fixed-size bitmaps of hashed keys, built and probed with native SQL functions.

A bitmap has at most ``MAX_BITS`` bits (16 MB), or the bound its caller states, whatever the input:
that is the proven bound of all that is broadcast here. A bitmap has false positives but no false
negatives, so it only ever lets more rows through to the exact step behind it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 27
#: A bitmap of more set bits than this share filters too little; callers take the join instead.
USEFUL_SHARE = 0.5


def bits_for(n: int, each: int = 16, most: int = MAX_BITS) -> int:
    """A power of two near ``each`` bits a key, at least one bucket, at most ``most``."""
    return min(most, 1 << max(15, math.ceil(math.log2(max(1, n * each)))))


def slot(column: Column, bits: int) -> Column:
    return F.pmod(column, F.lit(bits)) + 1


def bitmap_rows(slots: DataFrame, column: str = "slot") -> DataFrame:
    """(bucket, bits): 4 KB bitmaps of the slots. At most MAX_BITS / 32768 rows."""
    return slots.groupBy(F.bitmap_bucket_number(column).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits")
    )


def bit_set(bits: Column, slot: Column) -> Column:
    """Whether the slot's bit is set in its bucket's bitmap (null: no such bucket)."""
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte.cast("long"), (position % 8).cast("int")) == 1, F.lit(False))


def to_numpy(rows: DataFrame, bits: int) -> np.ndarray:
    """The bitmap as bytes for numpy probes: bits / 8 bytes on the driver, at most 16 MB."""
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)[: len(out) - at]
    return out


def probe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For 64-bit keys whose slot is pmod(key, bits): a power of two, so the low bits."""
    at = keys.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def share_set(bitmap: np.ndarray) -> float:
    return float(np.bitwise_count(bitmap).sum()) / (len(bitmap) * 8)
