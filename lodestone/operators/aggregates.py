"""Roll-ups and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.numeric import clip, log_norm
from ..session import cut_lineage


def usage_rollup(usage: DataFrame, key: str = "repo") -> DataFrame:
    """Per project: dependencies, those seen in source, and total weight."""
    return usage.groupBy(key).agg(
        F.count("dependency").alias("n_deps"),
        F.count_if("source_match").alias("n_source"),
        F.sum("weighted_score").alias("total_weight"))


def usage_signal(usage: DataFrame, key: str = "repo") -> DataFrame:
    """Half the share of dependencies seen in source, half the log-scaled mean weight."""
    rolled = usage_rollup(usage, key)
    n = F.greatest(F.col("n_deps"), F.lit(1))
    rolled = rolled.withColumn("mean_weight", F.col("total_weight") / n)
    best = rolled.agg(F.max("mean_weight").alias("top")).scalar()
    ratio = clip(F.col("n_source") / n, 0.0, 1.0)
    intensity = clip(F.log1p("mean_weight") / F.log1p(best + F.lit(1e-9)), 0.0, 1.0)
    return rolled.select(key, (ratio * 0.5 + intensity * 0.5).alias("usage_signal"))


def joined_on(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where the named columns agree; nulls agree with nulls."""
    for i, c in enumerate(columns):
        right = right.withColumnRenamed(c, f"_key{i}")
    agree = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(columns)]
    return left.join(right, agree, how).drop(*[f"_key{i}" for i in range(len(columns))])


def quantiles(df: DataFrame, value: str, shares: dict[str, float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles per group, interpolated; one column per name in ``shares``.

    Values are counted, sorted by range and written, each with the number of its slice. The
    sizes of the slices tell which of them hold the wanted ranks, and only those are read
    again. No task holds more than one slice, whatever the size of a group. Nulls do not count;
    a group of nulls alone has no row.
    """
    by = list(by)
    x = F.col(value).cast("double").alias("_x")
    counts = df.select(*by, x).filter("_x is not null").groupBy(*by, "_x").agg(
        F.count(F.lit(1)).alias("_n"))
    sliced = cut_lineage(counts.repartitionByRange(*by, "_x")
                         .withColumn("_slice", F.spark_partition_id()))
    sizes = sliced.groupBy(*by, "_slice").agg(F.sum("_n").alias("_size"))
    group = Window.partitionBy(*by)  # a row per slice
    sizes = sizes.select(*by, "_slice", "_size", F.sum("_size").over(group).alias("_all"),
                         (F.sum("_size").over(group.orderBy("_slice")) - F.col("_size")).alias("_before"))
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), (F.lit(share) * (F.col("_all") - 1)).alias("_at"))
                       for name, share in shares.items()])
    ranks = sizes.select("*", F.inline(wanted)).select(
        "*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank")
    ).filter("_rank >= _before and _rank < _before + _size")
    places = ranks.groupBy(*by, "_slice").agg(F.collect_list(
        F.struct("_name", "_at", (F.col("_rank") - F.col("_before")).alias("_rank"))).alias("_wanted"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_slice").orderBy("_x"))
    read = joined_on(sliced, places, [*by, "_slice"]).withColumn("_upto", upto)
    here = F.filter("_wanted", lambda w: (w["_rank"] < F.col("_upto"))
                    & (w["_rank"] >= F.col("_upto") - F.col("_n")))
    # A value at both ranks counts whole; else each by its nearness.
    found = read.select(*by, "_x", F.inline(here)).groupBy(*by, "_name", "_at").agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    low = F.floor("_at")
    met = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        (low + 1 - F.col("_at")) * F.col("_lo") + (F.col("_at") - low) * F.col("_hi"))
    return found.withColumn("_met", met).groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_met"))).alias(n) for n in shares])


RANK_ERROR = 0.0133  # of a sketch with the default size, with 99% confidence


def sketches(df: DataFrame, value: str, by: Sequence[str] = (), size: int = 200) -> DataFrame:
    """``by, sketch, n, total, least, most``: a mergeable summary of each group, a few KB whatever
    the group holds. Store one a batch and put them together with ``merged_sketches``. Nulls do
    not count."""
    x = F.col(value).cast("double")
    return df.filter(x.isNotNull()).groupBy(*by).agg(
        F.kll_sketch_agg_double(x, F.lit(size)).alias("sketch"), F.count(x).alias("n"), F.sum(x).alias("total"),
        F.min(x).alias("least"), F.max(x).alias("most"))


def merged_sketches(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summaries of the same groups from several batches as one each."""
    return parts.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.min("least").alias("least"), F.max("most").alias("most"))


def sketched_quantiles(parts: DataFrame, shares: dict[str, float]) -> dict[str, Column]:
    """Columns of values whose rank is within ``RANK_ERROR`` of each share of the group, besides
    the exact mean."""
    found = {n: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for n, q in shares.items()}
    return found | {"mean": F.col("total") / F.col("n")}


def summary(df: DataFrame, value: str, exact: bool = True) -> DataFrame:
    """Mean, median, least and largest. ``exact=False`` takes a sketch for the median."""
    rest = [F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")]
    if not exact:
        out = df.agg(*rest, F.percentile_approx(value, 0.5, 10000).alias("median"))
    else:
        median = quantiles(df, value, {"median": 0.5}).select("median").scalar()
        out = df.agg(*rest).withColumn("median", median)
    return out.select("mean", "median", "min", "max")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), column))


def quality_profile(df: DataFrame) -> DataFrame:
    """Zeros and nulls per numeric column in one pass, clean columns left out."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    measured = df.agg(
        *[F.struct(F.count_if(F.col(c) == 0).alias("zeros"),
                   F.count_if(F.col(c).isNull()).alias("nulls"),
                   F.count(F.lit(1)).alias("total")).alias(c) for c in numeric])
    return (measured.unpivot([], numeric, "column", "m")
            .select("column", "m.zeros", "m.nulls", "m.total")
            .filter("zeros > 0 OR nulls > 0"))


def hit_rates(usage: DataFrame) -> DataFrame:
    """How often dependencies were found, over projects that did not fail."""
    ok = usage.filter(F.col("file_count") >= 0)
    n = F.greatest(F.count(F.lit(1)), F.lit(1))

    def rate(condition):
        return F.round(F.count_if(condition) * 100 / n, 1)

    return ok.agg(
        F.countDistinct("repo").alias("repos_done"),
        F.count_if("manifest_match").alias("manifest_hits"),
        rate(F.col("manifest_match")).alias("manifest_pct"),
        F.count_if("source_match").alias("source_hits"),
        rate(F.col("source_match")).alias("source_pct"),
        F.count_if(F.col("weighted_score") > 0).alias("any_usage"),
        rate(F.col("weighted_score") > 0).alias("any_pct"),
        F.coalesce(F.sum("total_calls"), F.lit(0)).alias("total_calls"))


def top_dependencies(usage: DataFrame, n: int = 15) -> DataFrame:
    return (usage.filter(F.col("file_count") >= 0).groupBy("dependency")
            .agg(F.sum("weighted_score").alias("weight"))
            .orderBy(F.desc(F.round("weight", 6)), "dependency").limit(n))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts in buckets of fixed width, numbered from 0."""
    bucket = F.floor(F.col(value) / F.lit(width)).alias("bucket")
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: count, least, quartiles, mean, largest."""
    sums = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"),
                              F.max(value).alias("high"), F.avg(value).alias("mean"))
    parts = quantiles(df, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, [by])
    return joined_on(sums, parts, [by], "left").select(by, "n", "low", "q1", "q2", "q3", "high", "mean")


def mean_contributions(df: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """Mean of every weighted term, one row per term."""
    row = df.agg(*[F.avg(c).alias(n) for n, c in terms.items()])
    return row.unpivot([], list(terms), "term", "mean_contribution")


def quadrants(df: DataFrame, producer: str, consumer: str, producer_cut: float,
              consumer_cut: float) -> DataFrame:
    side = F.when(F.col(producer) >= producer_cut, "high").otherwise("low")
    other = F.when(F.col(consumer) >= consumer_cut, "high").otherwise("low")
    return df.groupBy(side.alias("producer_side"), other.alias("consumer_side")).agg(
        F.count(F.lit(1)).alias("n"))


def ordered_text(df: DataFrame, keys: Sequence[str], order: str, *texts: str,
                 width: int | None = None) -> DataFrame:
    """Comma-joined texts per key, in a given order, a column each.

    Rows are sorted by range, about ``width`` rows a slice if given. A slice's rows of a key
    are joined first, so the pieces of a very long list are joined in parallel, however
    thinly its order numbers lie; the last step holds a piece per slice and the result.
    """
    def joined(by):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(by), *texts)))
        return [F.array_join(pairs[t], ",").alias(t) for t in texts]

    rows, slices = df.select(*keys, order, *texts), []
    if width:
        slices = [max(1, -(-rows.count() // width))]
    sliced = cut_lineage(rows.repartitionByRange(*slices, *keys, order)
                         .withColumn("_slice", F.spark_partition_id()))
    return sliced.groupBy(*keys, "_slice").agg(*joined(order)).groupBy(*keys).agg(*joined("_slice"))


def package_rollup(packages: DataFrame, key: str = "repo_url") -> DataFrame:
    """Several packages to one row per project.

    Takes ``key, ord, ecosystem, package, version, direct, transitive, found``; packages
    not found add nothing. Projects without any found package keep a row of defaults.
    """
    sums = packages.groupBy(key).agg(
        F.bool_or("found").alias("depsdev_found"),
        F.max_by(F.when(F.col("found"), F.col("version")),
                 F.when(F.col("found"), F.col("ord"))).alias("depsdev_version"),
        F.sum(F.when(F.col("found"), F.col("direct")).otherwise(0)).alias("depsdev_direct_deps"),
        F.sum(F.when(F.col("found"), F.col("transitive")).otherwise(0))
        .alias("depsdev_transitive_deps"))
    listed = packages.filter("found").select(
        key, "ord", F.col("ecosystem").alias("depsdev_ecosystem"), F.col("package").alias("depsdev_package"))
    out = sums.join(ordered_text(listed, [key], "ord", "depsdev_ecosystem", "depsdev_package"), key, "left")
    return out.fillna("", ["depsdev_ecosystem", "depsdev_package", "depsdev_version"])


def global_log_norm(df: DataFrame, value: str, floor: float | None = None,
                    positive_only: bool = False) -> Column:
    """``value`` on a log scale against the table's largest, optionally with a floor for
    that largest, or leaving zeros out."""
    x = F.col(value)
    largest = F.max(F.nullif(x, F.lit(0))) if positive_only else F.max(x)
    best = df.agg(largest.alias("top")).scalar()
    if floor is not None:
        best = F.greatest(best, F.lit(floor))
    return log_norm(x, best)
