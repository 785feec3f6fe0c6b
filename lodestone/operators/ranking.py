"""Sorting, limits and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Whole table by falling score; ``tie`` makes the order total."""
    return df.orderBy(F.desc(score), tie)


def best(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    return ranked(df, score, tie).limit(n)


def best_and_worst(df: DataFrame, score: str, tie: str, n: int = 15) -> DataFrame:
    low = df.orderBy(F.asc(score), tie).limit(n).withColumn("side", F.lit("bottom"))
    return best(df, score, tie, n).withColumn("side", F.lit("top")).unionByName(low)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    spread: Column, salts: int = 64) -> DataFrame:
    """First ``n`` rows of each group, exactly, with their position ``rn``.

    Two rounds: each group is first cut to ``n`` within each of ``salts`` slices, so the
    second round sees ``salts * n`` rows of a group at most. Spark cuts inside the map
    tasks of both rounds already.
    """
    slice_ = F.pmod(F.xxhash64(spread), F.lit(salts)).alias("_slice")
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    over = Window.partitionBy(*keys).orderBy(*order)
    cut = (df.select("*", slice_).withColumn("_r", F.row_number().over(within))
           .filter(F.col("_r") <= n).drop("_r", "_slice"))
    return cut.withColumn("rn", F.row_number().over(over)).filter(F.col("rn") <= n)


def first_success(candidates: DataFrame, key: str, priority: str, qualifies: Column,
                  columns: Sequence[str]) -> DataFrame:
    """Per key the qualifying candidate of least priority number; keys without one keep a
    row, with nulls."""
    hit = F.min_by(F.when(qualifies, F.struct(*columns)),
                   F.when(qualifies, F.col(priority)))
    picked = candidates.groupBy(key).agg(hit.alias("_hit"))
    return picked.select(key, *[F.col(f"_hit.{c}").alias(c) for c in columns])


def default_or_last(versions: DataFrame, key: str, version: str, is_default: str,
                    order: Sequence[str]) -> DataFrame:
    """The first version flagged default, else the last listed."""
    position = F.struct(*order)
    flagged = F.min_by(F.when(F.col(is_default), F.col(version)),
                       F.when(F.col(is_default), position))
    return versions.groupBy(key).agg(
        F.coalesce(flagged, F.max_by(F.col(version), position)).alias(version))
