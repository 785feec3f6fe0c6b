"""Exact duplicates by progressive refinement, in built-in expressions only.

Texts are told apart by length, then by a hash of their first characters, and only those that
still share both with another text are read whole and hashed. The lengths and prefix hashes that
occur more than once are kept as a bitmap of bounded size, which is broadcast to the second read
of the texts: no text crosses an exchange. A clash of two slots in the bitmap costs one needless
hash and changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skewed_join
from ..operators.prefilter import may_match
from ..session import cut_lineage

PREFIX = 64


def normalised(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; null is empty.

    Where every character is ASCII the faster ``lower`` does the same.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def stamped(docs: DataFrame, text: str, prefix: int) -> DataFrame:
    """``docs`` with ``_size`` and ``_head``: bytes of the text, hash of its first characters."""
    return docs.withColumns({
        "_size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
        "_head": F.xxhash64(normalised(F.substring(text, 1, prefix)))})


def exact_duplicates(docs: DataFrame, key: str, text: str, keep: Sequence[str] = (),
                     prefix: int = PREFIX) -> DataFrame:
    """``key, keep_key, group_size, kept`` and the columns ``keep`` for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts
    one row stays, that of the largest key; a null key is below all others, and of repeated rows
    one stays. ``keep_key`` is the key that stays. Identity is that of length, prefix hash and
    SHA-256.

    Both reads of the texts reduce them to numbers in the scan. A text with very many copies is
    counted before its shuffle, and its rows are spread in the join that names the one that
    stays. The bitmap has 16 bits a shared length and prefix, 2^28 at most; where more are
    shared, more texts are hashed whole.
    """
    extra = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("struct<none:int>")
    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), extra.alias("_extra"))
    met = stamped(base.select("_text"), "_text", prefix).groupBy("_size", "_head").count().filter("count > 1")
    shared = cut_lineage(met.select("_size", "_head"))
    marked = may_match(stamped(base, "_text", prefix), shared, "_size", "_head")
    whole = F.when(F.col("_may"), F.unhex(F.sha2(normalised(F.col("_text")), 256)))
    rows = cut_lineage(marked.select(
        "_key", "_extra", "_size", whole.alias("_whole"), F.monotonically_increasing_id().alias("_row")))
    same = F.struct("_size", "_whole").alias("_same")
    again = rows.filter("_whole is not null").select("_key", "_extra", "_row", same)
    best = F.max(F.struct("_key", "_row")).alias("_best")
    groups = again.groupBy("_same").agg(best, F.count(F.lit(1)).alias("_n"))
    named = skewed_join(again, groups, "_same", F.col("_row")).select(
        "_key", "_extra", F.col("_best._key").alias("_keep"), "_n", (F.col("_row") == F.col("_best._row")).alias("_kept"))
    lone = rows.filter("_whole is null").select(
        "_key", "_extra", F.col("_key").alias("_keep"), F.lit(1).cast("long").alias("_n"), F.lit(True).alias("_kept"))
    return named.union(lone).select(
        F.col("_key").alias("key"), F.col("_keep").alias("keep_key"), F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"), *[F.col(f"_extra.{c}").alias(c) for c in keep])
