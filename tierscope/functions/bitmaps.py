"""Bitmaps of hashed keys, of a bounded size: a filter before a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_BITS = 26  # 8 MB at most


def _slot(keys: Sequence[str], slot_bits: int) -> tuple[Column, Column]:
    """The word of the bitmap that a key's slot is in, and the bit."""
    slot = F.shiftrightunsigned(F.xxhash64(*keys), 64 - slot_bits)
    return F.shiftrightunsigned(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")


def key_bitmap(df: DataFrame, keys: Sequence[str], slot_bits: int = SLOT_BITS) -> DataFrame:
    """Rows (word, bits) of 64 slots each: where keys are, 2**slot_bits / 64 rows at most."""
    word, place = _slot(keys, slot_bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    return df.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def maybe_in(
    df: DataFrame, keys: Sequence[str], bitmap: DataFrame, slot_bits: int = SLOT_BITS
) -> DataFrame:
    """Rows whose key may be in a bitmap; those left out surely are not.

    The bitmap goes to all tasks: its size is bounded by its number of slots. A fuller one leaves
    out fewer rows. The types of the keys must be those that the bitmap was made of.
    """
    word, place = _slot(keys, slot_bits)
    named = bitmap.select(F.col("word").alias("word_"), F.col("bits").alias("bits_"))
    hit = F.call_function("shiftrightunsigned", F.col("bits_"), place).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(named), word == F.col("word_")).where(hit).drop("word_", "bits_")
