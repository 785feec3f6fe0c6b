"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's weight is its token share raised to an exponent and normalised. The exponent is
bisected to meet a target entropy or a limit on repetition. The weights are then realised:
every source's documents are dealt to blocks, each epoch runs through the blocks in an order
of its own, and a source stops when its token budget is spent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, md5_bits

BLOCKS = 4096
BITS = 40


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space plus one for the document's end; null text: 1."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long") + 1


def source_tokens(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """``source, total, share`` per source; a null source is one of its own."""
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("total"))
    return sums.withColumn("share", F.col("total") / sums.agg(F.sum("total").alias("t")).scalar())


def bisect_exponent(shares: DataFrame, max_repeat: float | None = None,
                    entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1], to 40 bits.

    ``max_repeat``: the smallest at which no source is seen more often. Without ``budget``
    (tokens as a multiple of the corpus) the budget is the least that shows every document
    once. ``entropy``: the largest at which the weights' entropy, in nats, is not below it.
    Four halvings are settled by each pass over the sources' table; only its maxima and sums
    come back.
    """
    if (max_repeat is None) == (entropy is None):
        raise ValueError("give max_repeat or entropy")
    lo, hi, p = 0.0, 1.0, F.col("share")
    for _ in range(BITS // 4):
        step = (hi - lo) / 16
        tried = [lo + j * step for j in range(1, 16)]
        row = shares.agg(*[f for j, a in enumerate(tried) for f in (
            F.sum(F.pow(p, F.lit(a))).alias(f"z{j}"),
            F.max(F.pow(p, F.lit(a - 1))).alias(f"r{j}"),
            F.max(F.pow(p, F.lit(1 - a))).alias(f"c{j}"),
            F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"e{j}"))]).first()
        if row["z0"] is None:
            return 1.0

        def passed(j: int) -> bool:
            """Is the wanted exponent at this one or below it?"""
            if entropy is not None:
                return math.log(row[f"z{j}"]) - tried[j] * row[f"e{j}"] / row[f"z{j}"] < entropy
            scale = row[f"c{j}"] if budget is None else budget / row[f"z{j}"]
            return row[f"r{j}"] * scale <= max_repeat

        at = next((j for j in range(15) if passed(j)), None)
        lo, hi = (tried[-1], hi) if at is None else (tried[at] - step, tried[at])
    return lo if entropy is not None else hi


def weigh(shares: DataFrame, exponent: float, budget: float | None = None,
          blocks: int = BLOCKS) -> DataFrame:
    """Adds ``weight``, ``allowance`` (tokens, whole) and ``blocks`` (by share) per source."""
    raised = shares.withColumn("_w", F.pow("share", F.lit(exponent)))
    sums = raised.agg(F.sum("_w").alias("z"), F.max(F.col("total") / F.col("_w")).alias("c"),
                      F.sum("total").alias("t"))
    z = sums.select("z").scalar()
    whole = (sums.select(F.col("c") * F.col("z")).scalar() if budget is None
             else sums.select(F.col("t") * F.lit(float(budget))).scalar())
    return (raised.withColumn("weight", F.col("_w") / z)
            .withColumn("allowance", F.round(F.col("weight") * whole).cast("long"))
            .withColumn("blocks", (F.lit(1) + F.floor(F.col("share") * blocks)).cast("long"))
            .drop("_w"))


def _block(key: Column, seed: int, blocks: Column) -> Column:
    return F.pmod(md5_bits(F.concat_ws("|", F.lit(f"block{seed}"), key)), blocks)


def _order(key: Column, seed: int) -> Column:
    return md5_bits(F.concat_ws("|", F.lit(f"order{seed}"), key))


def block_plan(rows: DataFrame, weights: DataFrame, seed: int = 0) -> DataFrame:
    """``source, block, epoch, place, cutoff``: blocks each epoch shows, in which place, and
    for the block in which the allowance ends the first order that is left out.

    ``rows`` has ``key, source, tokens``. Only the block where a source ends is sorted by
    document; other blocks are summed. Sources and blocks together are at most their number
    plus 4,096.
    """
    w = weights.select(F.col("source").alias("_s"), "total", "allowance", "blocks")
    dealt = rows.join(w, rows["source"].eqNullSafe(F.col("_s"))).select(
        "source", "key", "tokens", "total", "allowance",
        _block(F.col("key"), seed, F.col("blocks")).alias("block"))
    sums = cut_lineage(dealt.groupBy("source", "block", "total", "allowance").agg(
        F.sum("tokens").alias("size")))
    last = F.floor(F.col("allowance") / F.col("total"))
    epochs = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    shuffled = epochs.withColumn("_h", md5_bits(F.concat_ws(
        "|", F.lit(f"epoch{seed}"), F.col("epoch"), F.col("source"), F.col("block"))))
    turn = Window.partitionBy("source", "epoch").orderBy("_h", "block")
    placed = (shuffled.withColumn("place", F.row_number().over(turn) - 1)
              .withColumn("_start", F.sum("size").over(turn) - F.col("size"))
              .withColumn("_left", F.col("allowance") - F.col("epoch") * F.col("total")
                          - F.col("_start"))
              .filter("_left > 0"))
    ends = placed.filter("_left < size").select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("_left").alias("_l"))
    ending = dealt.join(F.broadcast(ends), dealt["source"].eqNullSafe(F.col("_s"))
                        & (dealt["block"] == F.col("_b")))
    run = Window.partitionBy("source", "block").orderBy("_o").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    each = ending.groupBy("source", "block", "_l", _order(F.col("key"), seed).alias("_o")).agg(
        F.sum("tokens").alias("tokens"))
    cut = (each.withColumn("_start", F.sum("tokens").over(run) - F.col("tokens"))
           .filter("_start >= _l").groupBy("source", "block").agg(F.min("_o").alias("cutoff")))
    cut = cut.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "cutoff")
    out = placed.join(cut, placed["source"].eqNullSafe(F.col("_s"))
                      & (placed["block"] == F.col("_b")) & (F.col("_left") < F.col("size")), "left")
    return out.select("source", "block", "epoch", F.col("place").cast("long").alias("place"), "cutoff")


def mix(docs: DataFrame, key: str, source: str, text: str, max_repeat: float | None = 2.0,
        entropy: float | None = None, budget: float | None = None, seed: int = 0,
        blocks: int = BLOCKS) -> DataFrame:
    """Rows of ``docs`` as often as the mixture shows them, with ``epoch, block, place,
    tokens, weight``: a reader that takes epochs, places and orders in turn meets the target
    weights. Columns of these names are replaced.

    Tokens are words plus one. Texts are not shuffled: rows meet the small block plan where
    they are read. Rows with one key go together; a null key is one more key, a null source
    one more source. Without ``budget`` every document is shown at least once.
    """
    added = ["epoch", "block", "place", "tokens", "weight"]
    base = docs.select(*[F.col(c) for c in docs.columns if c not in added],
                       word_tokens(F.col(text)).alias("tokens"))
    id_ = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = cut_lineage(base.select(id_.alias("key"), F.col(source).alias("source"), "tokens"))
    shares = cut_lineage(source_tokens(rows, "source", "tokens"))
    exponent = bisect_exponent(shares, max_repeat, entropy, budget)
    weights = cut_lineage(weigh(shares, exponent, budget, blocks))
    plan = cut_lineage(block_plan(rows, weights, seed))
    w = weights.select(F.col("source").alias("_s"), F.col("weight"), F.col("blocks").alias("_n"))
    p = plan.select(F.col("source").alias("_ps"), F.col("block").alias("_pb"),
                    "epoch", "place", "cutoff")
    dealt = base.join(w, base[source].eqNullSafe(F.col("_s"))).withColumn(
        "block", _block(id_, seed, F.col("_n"))).withColumn("_o", _order(id_, seed))
    met = dealt.join(p, F.col(source).eqNullSafe(F.col("_ps")) & (F.col("block") == F.col("_pb")))
    return met.filter(F.col("cutoff").isNull() | (F.col("_o") < F.col("cutoff"))).drop(
        "_s", "_n", "_ps", "_pb", "_o", "cutoff")
