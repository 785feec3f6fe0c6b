"""Keys as a bitmap of bounded size, to keep rows that cannot match out of a join.

A key sets one bit, found by its hash. A row whose bit is not set surely has no match, so it need
not be shuffled; a set bit says only that it may have one. More keys than a sixteenth of the bits
make the bitmap less sharp, never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 1 << 15  # bits of one row of the bitmap
MOST_BITS = 1 << 28  # 32 MB in all
BITS_PER_KEY = 16


def bits_for(keys: int) -> int:
    """Bits for so many keys: a power of two, 2^28 at most."""
    bits = PAGE
    while bits < min(MOST_BITS, BITS_PER_KEY * keys):
        bits *= 2
    return bits


def slot(bits: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def bitmap(keys: DataFrame, bits: int, *key: str) -> DataFrame:
    """``_page, _bits``: the slots of all rows, in at most ``bits / PAGE`` rows. Built in parts
    ahead of the shuffle, and kept as numbers of 64 bits, of which a row reads one."""
    pages = keys.groupBy(F.floor(slot(bits, *key) / PAGE).alias("_page")).agg(
        F.bitmap_construct_agg(slot(bits, *key) % PAGE).alias("_bits"))
    starts = F.sequence(F.lit(1), F.lit(PAGE // 8), F.lit(8))
    # base -10 gives signed numbers
    return pages.select("_page", F.transform(starts, lambda i: F.conv(
        F.hex(F.substring(F.col("_bits"), i, F.lit(8))), 16, -10).cast("bigint")).alias("_bits"))


def is_set(bits: int, *key: str) -> Column:
    """Is this row's slot set in its page ``_bits``? A missing page is empty. A page's first byte is
    its first number's highest, and a byte's first bit its lowest."""
    place = (slot(bits, *key) % PAGE).cast("int")
    number = F.get("_bits", F.shiftright(place, 6))
    return F.coalesce(F.getbit(number, (place % 64).bitwiseXOR(F.lit(56))) == 1, F.lit(False))


def with_pages(df: DataFrame, pages: DataFrame, bits: int, *key: str) -> DataFrame:
    """``df`` beside the page of its key; the bitmap is broadcast, 32 MB at most."""
    return df.withColumn("_page", F.floor(slot(bits, *key) / PAGE)).join(F.broadcast(pages), "_page", "left")


def may_match(df: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """``df`` with ``_may``: false where no row of ``keys`` has this key. ``keys`` is counted and
    read once more, so pass a table."""
    bits = bits_for(keys.count())
    return (with_pages(df, bitmap(keys, bits, *key), bits, *key)
            .withColumn("_may", is_set(bits, *key)).drop("_page", "_bits"))
