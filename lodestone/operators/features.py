"""Feature assembly: from joined source columns to the numbers the score uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import (
    age_adjusted, age_years, clip, ecosystem_factor, first_positive, log_norm, lookup,
    to_number,
)

LOCK_COLUMNS = [
    "cargo_lock_total_packages", "go_sum_unique_modules",
    "depsdev_direct_deps", "depsdev_transitive_deps",
]


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def created_column(columns: Sequence[str]) -> str | None:
    """First column whose name mentions creation."""
    return next((c for c in columns if "created" in c.lower()), None)


def label_column(columns: Sequence[str]) -> str:
    return "average_originality" if "average_originality" in columns else "originality"


def with_age(df: DataFrame, as_of: str) -> DataFrame:
    """Age in years; 3.0 for all where the table has no creation column."""
    column = created_column(df.columns)
    age = (age_years(F.col(column).cast("string"), as_of) if column
           else F.lit(fixed.AGE_NO_COLUMN))
    return df.withColumn("repo_age_years", age)


def top(df: DataFrame, value: Column) -> Column:
    """Largest value of the table as a one-value subquery: no window, no cross join."""
    return df.agg(F.max(value).alias("top")).scalar()


def with_unified_count(df: DataFrame) -> DataFrame:
    """Dependency count from the first positive source, a proxy where that leaves 0, then
    the ecosystem's scale."""
    counted = first_positive(
        [F.col("graph_dep_count"), F.col("cargo_lock_total_packages"),
         F.col("go_sum_unique_modules"), F.col("depsdev_transitive_deps")],
        F.coalesce(F.col("dependency_count"), F.lit(0)))
    df = df.withColumn("unified_dep_count", counted.cast("double"))
    proxied = proxy_override(F.col("unified_dep_count"), F.col("repo_name"))
    df = df.withColumn("unified_dep_count", proxied)
    factor = ecosystem_factor(F.col("cargo_lock_total_packages"),
                              F.col("go_sum_unique_modules"), F.col("depsdev_ecosystem"))
    return df.withColumn("scaled_dep_count", F.col("unified_dep_count") * factor)


def proxy_override(count: Column, name: Column, proxies: dict[str, float] | None = None) -> Column:
    """Assumed count by exact name, only where nothing was counted."""
    table = {k: float(v) for k, v in (proxies or fixed.PROXY_COUNTS).items()}
    proxy = lookup(name, table, None)
    return F.when(count == 0, F.coalesce(proxy, count)).otherwise(count)


def with_age_adjusted(df: DataFrame) -> DataFrame:
    return df.withColumn("age_adj_dep_count",
                         age_adjusted(F.col("scaled_dep_count"), F.col("repo_age_years")))


def activity_raw(age: Column, commits: Column) -> Column:
    return F.log1p(F.greatest(age, F.lit(fixed.AGE_FLOOR))
                   * F.greatest(F.coalesce(commits, F.lit(0)), F.lit(0)))


def with_norms(df: DataFrame) -> DataFrame:
    """Star and activity scores against the largest of the table.

    Both maxima come from one pass over the pruned columns.
    """
    raw = activity_raw(F.col("repo_age_years"), F.col("commits_last_year"))
    tops = df.agg(F.struct(F.max("stars").alias("stars"), F.max(raw).alias("activity"))
                  .alias("t")).scalar()
    stars = F.coalesce(F.col("stars"), F.lit(0))
    return (df.withColumn("star_score", F.coalesce(log_norm(stars, tops["stars"]), F.lit(0.0)))
            .withColumn("activity_score", F.coalesce(
                raw / F.nullif(tops["activity"], F.lit(0.0)), F.lit(0.0))))


def direct_ratio(total: Column, direct: Column, registry_direct: Column) -> Column:
    """Share of direct dependencies; a project without dependencies counts as all direct."""
    counted = F.coalesce(direct, registry_direct, F.lit(0))
    return F.when(total == 0, F.lit(1.0)).otherwise(clip(counted / total, 0.0, 1.0))


def with_signals(df: DataFrame, signals: DataFrame | None, key: str, order: str = "landed") -> DataFrame:
    """Model signals under short names, unreadable or missing ones 0. Of a repeated key the row
    that is last by ``order`` holds, if there is such a column; of several last ones, or without
    it, the one with the largest values, whichever task reads them."""
    if signals is None:
        return with_defaults(df, {dest: 0.0 for dest in fixed.SIGNALS})
    present = {d: s for d, s in fixed.SIGNALS.items() if s in signals.columns}
    values = F.struct(*[to_number(F.col(s)).alias(d) for d, s in present.items()]) if present else F.struct(
        F.lit(1).alias("_none"))
    at = F.col(order) if order in signals.columns else F.lit(0)
    picked = (signals.select(key, F.struct(at.alias("at"), values.alias("v")).alias("_p"))
              .groupBy(key).agg(F.max("_p").alias("_p")).select(key, F.col("_p.v").alias("_v"))
              .select(key, *[F.col(f"_v.{d}").alias(d) for d in present]))
    out = df.join(picked, key, "left")
    return with_defaults(out, {d: 0.0 for d in fixed.SIGNALS})


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Missing columns are added, nulls in present ones replaced."""
    return df.withColumns({
        name: (F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
        for name, value in defaults.items()})


GRAPH_DEFAULTS = {"producer_score": 0.0, "consumer_score": 0.0, "pc_ratio": 0.5}
