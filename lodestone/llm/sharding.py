"""Sharding by rendezvous hashing, in DataFrame operations only.

Every shard draws a score from the record's key and the shard's own number; the best score
wins. Adding a shard therefore moves only rows that the new shard wins, and removing one
moves only its own rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCKS = 4096


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard (an int) of a key among ``weights``, shard number -> weight above 0.

    A score is -ln(u) / weight, with u in (0, 1) drawn by hashing key and shard; the least
    wins, ties go to the smaller number. Shards win keys in proportion to their weights. A
    null key is one more key.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must name a shard, all above 0")

    def drawn(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        u = (bits + F.lit(0.5)) * F.lit(2.0 ** -53)
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"),
                        F.lit(shard).alias("shard"))

    draws = [drawn(s, w) for s, w in sorted(weights.items())]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def with_slots(df: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """Adds a row's place in its shard, gapless from 0. ``df`` should hold narrow rows: it is
    written once.

    Each shard is cut in 4,096 blocks by a running number, not by a key, so neither a large
    shard nor a hot key reaches one task. Blocks are counted, the counts (4,096 a shard)
    summed up, and rows numbered within their block.
    """
    dealt = cut_lineage(df.withColumn("_block", F.pmod(
        F.xxhash64(F.monotonically_increasing_id()), F.lit(BLOCKS)).cast("int")))
    sizes = dealt.groupBy(F.col(shard).alias("_s"), F.col("_block").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"))
    before = sizes.selectExpr(
        "_s", "_b", "sum(_n) over (partition by _s order by _b) - _n as _before")
    rest = [F.col(c) for c in df.columns]
    numbered = dealt.withColumn("_i", F.row_number().over(
        Window.partitionBy(shard, "_block").orderBy(*rest)) - 1)
    met = numbered.join(F.broadcast(before), (numbered[shard].eqNullSafe(before["_s"]))
                        & (numbered["_block"] == before["_b"]))
    return met.select(*rest, (F.col("_before") + F.col("_i")).cast("long").alias(slot))


def shard_records(df: DataFrame, key: str, weights: Mapping[int, float],
                  grown: Mapping[int, float] | None = None) -> DataFrame:
    """``df`` with ``shard`` (and ``grown_shard`` under the weights ``grown``).

    No shuffle. Columns of these names are replaced. Empty tables stay empty; repeated rows
    and rows of one key share a shard.
    """
    out = df.withColumn("shard", rendezvous(F.col(key), weights))
    return out.withColumn("grown_shard", rendezvous(F.col(key), grown)) if grown else out
