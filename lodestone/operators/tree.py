"""File tree statistics per project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def tree_stats(items: DataFrame, key: str = "repo") -> DataFrame:
    """Counts, depth and presence flags from ``key, path, type, size, ord``.

    One aggregation, combined ahead of its shuffle. The extension is the text after the
    last dot of the whole path, and a test word counts anywhere in it: ``latest/x.go`` is a
    test file.
    """
    path, lowered = F.col("path"), F.lower("path")
    is_file = F.col("type") == "blob"
    ext = F.when(F.contains(lowered, F.lit(".")), F.substring_index(lowered, ".", -1))
    source = is_file & F.coalesce(ext.isin(fixed.TREE_SOURCE_EXT), F.lit(False))
    config = is_file & F.coalesce(ext.isin(fixed.TREE_CONFIG_EXT), F.lit(False))
    tested = F.contains(lowered, F.lit("test")) | F.contains(lowered, F.lit("spec"))

    def has(*conditions):
        return F.coalesce(F.bool_or(reduce(lambda a, b: a | b, conditions)), F.lit(False))

    def begins(*prefixes):
        return [F.startswith(lowered, F.lit(p)) for p in prefixes]

    def mentions(*words):
        return [F.contains(lowered, F.lit(w)) for w in words]

    readme = is_file & F.startswith(lowered, F.lit("readme"))
    return items.groupBy(key).agg(
        F.count_if(is_file).alias("total_files"),
        F.count_if(F.col("type") == "tree").alias("total_dirs"),
        F.max(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))
        .alias("tree_depth"),
        has(*[F.startswith(path, F.lit(p)) for p in fixed.CI_PATHS]).alias("has_ci_cd"),
        has(*mentions("dockerfile", "docker-compose")).alias("has_dockerfile"),
        has(*begins("docs/", "doc/")).alias("has_docs"),
        has(F.contains(F.substring_index(lowered, "/", 1), F.lit("test")),
            *begins("spec/")).alias("has_tests"),
        has(*begins("examples/", "example/")).alias("has_examples"),
        has(*mentions("benchmark", "bench/")).alias("has_benchmarks"),
        F.coalesce(F.min_by(F.when(readme, F.coalesce(F.col("size"), F.lit(0))),
                            F.when(readme, F.col("ord"))), F.lit(0)).alias("readme_size"),
        F.count_if(source & ~tested).alias("src_file_count"),
        F.count_if(source & tested).alias("test_file_count"),
        F.count_if(config).alias("config_file_count"))
