"""A Bloom filter of fixed size over 64-bit hashes: rows that cannot join are left out before an exchange.

Where it fills up, more rows pass and none is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The filter has 2**BITS bits; a hash sets one for each group of that many of its bits from these places on.
BITS, PROBES = 24, (40, 20, 0)


def bloom_of(df: DataFrame, column: str) -> np.ndarray:
    """The filter of a column's hashes; gathered as at most 2**(BITS - 6) words, however many they are."""
    slots = F.array(*[F.shiftrightunsigned(column, at).bitwiseAND(F.lit((1 << BITS) - 1)) for at in PROBES])
    slot = df.select(F.explode(slots).alias("slot"))
    words = slot.select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out.view(np.uint8)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes (uint64) that may be in the filter."""
    hit = np.arange(len(hashes))
    for at in PROBES:
        slot = ((hashes[hit] >> np.uint64(at)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        hit = hit[((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)]
    return hit


def passing(df: DataFrame, column: str, members: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose hash may be one of the members', by a filter of 2**BITS bits and one probe.

    The filter is a table of at most 2**(BITS - 6) rows of 64 bits, so it is broadcast, and no row leaves the JVM.
    """
    slot = lambda c: F.shiftrightunsigned(c, 64 - BITS)
    bit = lambda c: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{c}`, {64 - BITS}) % 64 as int))")
    words = members.select(F.shiftright(slot(key), 6).alias("_word"), bit(key).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = df.withColumn("_word", F.shiftright(slot(column), 6)).join(F.broadcast(words), "_word")
    return met.filter(F.col("_bits").bitwiseAND(bit(column)) != 0).select(*df.columns)
