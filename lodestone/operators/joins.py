"""Joins, lookups and set operations over project tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import canonical
from ..functions.numeric import bound
from .prefilter import may_match


def hot_keys(df: DataFrame, key: str, limit: int = 1000) -> DataFrame:
    """Keys that each hold more than ``1/limit`` of all rows, and in ``_hot`` how many such
    parts each holds, rounded up.

    Fewer than ``limit`` keys can do that, so the result is safe to broadcast however
    large ``df`` is. The parts of all of them are fewer than twice ``limit``.
    """
    return hot_counts(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, limit)


def hot_counts(counts: DataFrame, key: str, limit: int = 1000) -> DataFrame:
    """``hot_keys`` of rows that are counted already, ``key, _n``."""
    everything = counts.agg(F.sum("_n").alias("n")).scalar()
    parts = F.ceil(F.col("_n") * limit / everything).cast("bigint")
    return counts.filter(F.col("_n") * limit > everything).select(key, parts.alias("_hot"))


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns that can be hashed: a spread that a repeated task gives again."""
    plain = [f"`{f.name}`" for f in df.schema.fields
             if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("bigint")


def skewed_join(left: DataFrame, right: DataFrame, key: str, spread: Column,
                how: str = "inner", salts: int | None = None, limit: int = 1000,
                counted: DataFrame | None = None, rows_of: DataFrame | None = None) -> DataFrame:
    """Join on ``key`` where some keys may hold a large part of ``left``.

    Rows of a hot key are spread by ``spread`` over as many tasks as its share of the rows
    asks for, ``1/limit`` of all rows each, or over ``salts``; only the few matching rows of
    ``right`` are copied. Rows without a key meet nothing and are spread too. Other keys join
    as usual. ``counted`` has the same keys as ``left`` and is counted instead, where
    ``left`` is dear to compute. ``rows_of`` has the counts themselves, ``key, _n``, for all
    keys that can be hot.
    """
    hot = F.broadcast(hot_keys(left if counted is None else counted, key, limit) if rows_of is None
                      else hot_counts(rows_of, key, limit))
    parts = F.when(F.col("_hot").isNotNull(), F.lit(salts) if salts else F.col("_hot")).otherwise(1)
    own = F.when(F.col(key).isNull(), F.lit(salts or limit)).otherwise(parts)
    many = (left.join(hot, key, "left")
            .withColumn("_salt", F.pmod(F.xxhash64(spread), own.cast("bigint"))).drop("_hot"))
    few = (right.join(hot, key, "left")
           .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)))
           .drop("_hot"))
    return many.join(few, [key, "_salt"], how).drop("_salt")


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """Fail, when run, if a key occurs twice: a fan-out must never pass unseen.

    The grouping shuffles on the key the join needs anyway.
    """
    rest = [c for c in df.columns if c != key]
    packed = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    grouped = df.groupBy(key).agg(F.any_value(packed).alias("_row"),
                                  F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(
        F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(
        F.col("_row"))
    return grouped.select(key, checked.alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def assemble(base: DataFrame, sources: Sequence[tuple[DataFrame, Sequence[str]]],
             key: str) -> DataFrame:
    """Left-join each source, cut to the named columns, onto the base table."""
    out = base
    for source, columns in sources:
        out = out.join(one_row_per_key(source.select(key, *columns), key), key, "left")
    return out


def anchor_join(anchors: DataFrame, projects: DataFrame, key: str = "repo_url",
                name: str = "repo", case_insensitive: bool = False) -> DataFrame:
    """Labelled anchors joined to projects on the full URL.

    The match is case-sensitive unless asked otherwise, so anchors spelled in another
    case do not count.
    """
    def norm(c):
        return F.lower(c) if case_insensitive else c

    left = anchors.withColumn("_k", norm(canonical(F.col(name)))).drop(key)
    right = projects.withColumn("_k", norm(F.col(key)))
    return left.join(right, "_k", "inner").drop("_k")


def remaining(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``keys`` not done yet. A bitmap of the done keys, of bounded size, tells in the
    scan which rows surely are not; only the others meet the done table, however large it is."""
    told = may_match(keys, done.select(key), key)
    new, maybe = told.filter("not _may").drop("_may"), told.filter("_may").drop("_may")
    return new.union(maybe.join(done.select(key), key, "left_anti").select(*new.columns)).select(*keys.columns)


def induced(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges whose two ends are both known nodes; parallel edges and loops stay."""
    known = nodes.select(node)
    for end in ("dst", "src"):
        edges = edges.join(known.withColumnRenamed(node, end), end, "left_semi")
    return edges.select("src", "dst")


def lookup_default(df: DataFrame, table: DataFrame, key: str, value: str, default,
                   order: Sequence[str] | None = None) -> DataFrame:
    """Dictionary-style lookup: absent keys get the default, and among repeated keys the
    last by ``order`` holds."""
    if order:
        table = table.groupBy(key).agg(
            F.max_by(value, F.struct(*order)).alias(value))
    return skewed_join(df, table.select(key, value), key, row_hash(df), "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default)))


def tiered_lookup(df: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str,
                  default) -> DataFrame:
    """A key in the first table is answered there, otherwise by the second table. The two
    tables are joined first, so the rows asking move once."""
    a = first.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_first"))
    b = second.select(key, F.col(value).alias("_b"))
    found = F.when(F.col("_in_first"), F.col("_a")).otherwise(F.col("_b"))
    return (skewed_join(df, a.join(b, key, "full"), key, row_hash(df), "left")
            .withColumn(value, F.coalesce(found, F.lit(default)))
            .drop("_a", "_b", "_in_first"))


def append_results(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return existing.unionByName(batch, allowMissingColumns=True)


def distinct_targets(adjacency: DataFrame, targets: str) -> DataFrame:
    """Every dependency named anywhere, once."""
    return adjacency.select(F.explode(targets).alias("dependency")).distinct()


def done_minus_failed(results: DataFrame, key: str, status: str = "file_count") -> DataFrame:
    """Keys seen, less every key that has a failed row."""
    failed = results.filter(F.col(status) == -1).select(key)
    return results.select(key).distinct().subtract(failed)


def contains_join(df: DataFrame, text: str, phrases: Sequence[str], keep: Sequence[str] = ()
                  ) -> DataFrame:
    """One row per text and phrase it contains, case aside; for up to some hundred phrases.

    The text is lower-cased once and the phrases are filtered beside it, so no text is
    copied or shuffled.
    """
    listed = F.array(*[F.lit(p) for p in phrases])
    found = bound(F.lower(text), lambda t: F.filter(listed, lambda p: F.contains(t, p)))
    return df.select(*keep, F.explode(found).alias("keyword"))


def normalised(name: Column) -> Column:
    """Spelling in which terms and manifest names are compared."""
    return F.translate(F.lower(name), "-.", "__")


def terms_overlap(terms: Column, names: Column) -> Column:
    """Does any term equal any manifest name, spelling aside?"""
    return F.arrays_overlap(F.transform(terms, normalised), F.transform(names, normalised))
