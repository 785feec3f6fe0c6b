"""From partial source tables to scores.

Projects are keyed by ``repo_url``, one row each. Every other table may be missing. Schemas are
those of ``sources.readers``; the graphs have ``src, targets``, as ``readers.adjacency`` gives them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.keys import canonical, slug
from ..functions.text import classify, readme_signal
from ..session import cut_lineage
from .aggregates import usage_signal
from .features import (
    GRAPH_DEFAULTS, LOCK_COLUMNS, direct_ratio, label_column, with_age, with_age_adjusted, with_defaults,
    with_norms, with_signals, with_unified_count,
)
from .graph import neighbour_quality, producer_consumer
from .joins import anchor_join, assemble
from .scoring import scored, with_core_scores
from .tuning import tune

LOCKS = ["cargo_lock_total_packages", "go_sum_unique_modules"]
REGISTRY = ["depsdev_ecosystem", "depsdev_direct_deps", "depsdev_transitive_deps"]


def target_counts(graph: DataFrame | None, name: str, projects: DataFrame) -> DataFrame:
    """``projects`` with the number of targets under ``name``; null where the graph has no such
    source. Of a source spelled in several ways the longest list counts."""
    if graph is None:
        return projects.withColumn(name, F.lit(None).cast("bigint"))
    n = F.coalesce(F.size("targets"), F.lit(0)).cast("bigint")
    counts = graph.select(slug(F.col("src")).alias("id"), n.alias(name)).groupBy("id").agg(
        F.max(name).alias(name))
    return projects.join(counts, "id", "left")


def slug_edges(graph: DataFrame) -> DataFrame:
    each = graph.select("src", F.explode("targets").alias("dst"))
    return each.select(slug(F.col("src")).alias("src"), slug(F.col("dst")).alias("dst"))


def gathered(projects: DataFrame, as_of: str, graph: DataFrame | None = None,
             direct_graph: DataFrame | None = None, usage: DataFrame | None = None,
             signals: DataFrame | None = None, readmes: DataFrame | None = None,
             locks: DataFrame | None = None, registry: DataFrame | None = None,
             rules: Sequence = fixed.CATEGORY_RULES, by_name: dict | None = None) -> DataFrame:
    """Per project all features that need no maximum over the scores of others. Descriptions
    end here. A second row of a project in ``locks``, ``registry`` or ``readmes`` fails the run."""
    df = projects.withColumn("id", slug(F.col("repo_url")))
    wide = [(t, c) for t, c in ((locks, LOCKS), (registry, REGISTRY)) if t is not None]
    if readmes is not None:
        depth = readme_signal(F.col("readme_excerpt"))
        wide.append((readmes.select("repo_url", depth.alias("readme_tech_signal")), ["readme_tech_signal"]))
    df = assemble(df, wide, "repo_url")
    df = with_defaults(df, {**{c: 0 for c in LOCK_COLUMNS}, "depsdev_ecosystem": "", "readme_tech_signal": 0,
                            "dependency_count": 0, "topics": "", "has_benchmarks": False})
    df = target_counts(graph, "graph_dep_count", df).fillna(0, ["graph_dep_count"])
    df = with_age_adjusted(with_unified_count(with_age(df, as_of)))
    df = target_counts(direct_graph, "_direct", df)
    df = df.withColumn("direct_ratio", direct_ratio(
        F.col("unified_dep_count"), F.col("_direct"), F.col("depsdev_direct_deps"))).drop("_direct")
    if graph is None:
        df = df.withColumn("dep_quality", F.lit(0.0))
    else:
        df = df.join(neighbour_quality(slug_edges(graph), df.select("id")), "id")
    if usage is None:
        df = df.withColumn("usage_signal", F.lit(0.0))
    else:
        rolled = usage_signal(usage.withColumn("repo_url", canonical(F.col("repo"))), "repo_url")
        df = df.join(rolled, "repo_url", "left").fillna(0.0, ["usage_signal"])
    kind = classify(F.col("repo_name"), F.col("description"), F.col("topics"), F.col("language"), rules, by_name)
    df = with_signals(df, signals, "repo_url").withColumn("_kind", kind)
    return df.withColumns({"category": F.col("_kind.category"), "cat_bonus": F.col("_kind.bonus")}).drop(
        "_kind", "description", "topics")


def finished(base: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Adds the scores against the table's largest values and the graph's scores. ``base`` is
    read several times, so it is a written table."""
    df = with_core_scores(with_norms(base))
    return with_defaults(df, GRAPH_DEFAULTS) if edges is None else df.join(producer_consumer(edges, base), "id")


def features(projects: DataFrame, as_of: str, graph: DataFrame | None = None, **tables) -> DataFrame:
    """Finished features of all projects."""
    base = cut_lineage(gathered(projects, as_of, graph, **tables))
    return finished(base, None if graph is None else slug_edges(graph))


def fitted(table: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """Scores of finished features, under weights fitted to ``anchors`` (with ``target``) if any."""
    found = None if anchors is None else tune(cut_lineage(anchors))
    return scored(table, *found) if found else scored(table)


def score(projects: DataFrame, as_of: str, anchors: DataFrame | None = None, **tables) -> DataFrame:
    """Originality of every project, under weights fitted to labelled ``anchors`` (``repo`` and
    a label) where there are some that match. Takes the tables of ``gathered``."""
    table = cut_lineage(features(projects, as_of, **tables))
    if anchors is None:
        return scored(table)
    target: Column = F.col(label_column(anchors.columns)).cast("double").alias("target")
    labelled = anchors.select("repo", target).filter("target is not null")
    return fitted(table, anchor_join(labelled, table, name="repo").drop("repo"))
