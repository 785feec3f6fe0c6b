"""Producer and consumer scores of a dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import clip, sqrt_norm
from ..session import cut_lineage
from .joins import skewed_join


def collapsed(edges: DataFrame) -> DataFrame:
    """Parallel edges as one row with their number: each later pass moves less."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Collapsed edges between known nodes. Collapsing first leaves the two semi joins
    no hot rows of parallel edges. The rows end up by source, so that sums by target are
    combined ahead of their shuffle, hubs too."""
    known = nodes.select("id")
    out = collapsed(edges)
    for end in ("dst", "src"):
        out = out.join(known.withColumnRenamed("id", end), end, "left_semi")
    return out.select("src", "dst", "n")


def inbound_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges arriving at each node from known nodes, parallel ones counted."""
    degree = known_edges(edges, nodes).groupBy("dst").agg(F.sum("n").alias("inbound"))
    return nodes.select("id").join(degree.withColumnRenamed("dst", "id"), "id", "left") \
        .fillna(0, ["inbound"])


def producer_raw(edges: DataFrame, nodes: DataFrame, passes: int = 2) -> DataFrame:
    """Unrounded producer score.

    Pass 1 takes the square root of the inbound degree against the largest. Each further
    pass adds up, over a node's incoming edges, the score of the edge's source, and takes
    the square root against the largest again. Edges whose source scores 0 add nothing, so
    only scored nodes travel. Hub sources are spread by the edge's target. The known edges
    and every pass's node table are written once, as each is read several times.
    """
    if passes < 1:
        raise ValueError("passes must be at least 1")
    links = cut_lineage(known_edges(edges, nodes))
    arriving = cut_lineage(links.groupBy("dst").agg(F.sum("n").cast("double").alias("w")))
    for _ in range(1, passes):
        best = arriving.agg(F.max("w").alias("top")).scalar()
        scores = arriving.select(F.col("dst").alias("src"),
                                 sqrt_norm(F.col("w"), best).alias("score"))
        arriving = cut_lineage(
            skewed_join(links, scores, "src", F.col("dst"))
            .groupBy("dst").agg(F.sum(F.col("n") * F.col("score")).alias("w")))
    best = arriving.agg(F.max("w").alias("top")).scalar()
    scored = arriving.select(F.col("dst").alias("id"),
                             sqrt_norm(F.col("w"), best).alias("producer"))
    return nodes.select("id").join(scored, "id", "left").fillna(0.0, ["producer"])


def producer_score(edges: DataFrame, nodes: DataFrame, passes: int = 2) -> DataFrame:
    return producer_raw(edges, nodes, passes).select(
        "id", F.round("producer", 4).alias("producer_score"))


def consumer_raw(nodes: DataFrame, count: str = "age_adj_dep_count") -> DataFrame:
    """Unrounded log-scaled outgoing dependency count."""
    best = nodes.agg(F.max(count).alias("top")).scalar()
    return nodes.select("id", (F.log1p(count) / (F.log1p(best) + F.lit(1e-9))).alias("consumer"))


def consumer_score(nodes: DataFrame, count: str = "age_adj_dep_count") -> DataFrame:
    return consumer_raw(nodes, count).select("id", F.round("consumer", 4).alias("consumer_score"))


def producer_consumer(edges: DataFrame, nodes: DataFrame, passes: int = 2,
                      count: str = "age_adj_dep_count") -> DataFrame:
    """Producer score, consumer score and their ratio, rounded to 4 digits.

    The ratio is made from the unrounded scores.
    """
    both = producer_raw(edges, nodes, passes).join(consumer_raw(nodes, count), "id")
    both = both.withColumn("ratio", F.col("producer") / (F.col("consumer") + F.lit(0.1)))
    best = both.agg(F.max("ratio").alias("top")).scalar()
    return both.select(
        "id", F.round("producer", 4).alias("producer_score"),
        F.round("consumer", 4).alias("consumer_score"),
        F.round(F.col("ratio") / (best + F.lit(1e-9)), 4).alias("pc_ratio"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def neighbour_quality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Log-scaled mean dependency count of a node's own dependencies; a dependency that
    declares none counts 0."""
    links = cut_lineage(collapsed(edges))
    degree = links.groupBy("src").agg(F.sum("n").alias("out_degree"))
    seen = skewed_join(links.withColumnRenamed("dst", "dep"),
                       degree.withColumnRenamed("src", "dep"), "dep", F.col("src"), "left")
    mean = seen.groupBy("src").agg(
        (F.sum(F.col("n") * F.coalesce(F.col("out_degree"), F.lit(0))) / F.sum("n"))
        .alias("mean_out"))
    quality = clip(F.log1p("mean_out") / F.log1p(F.lit(float(fixed.NEIGHBOUR_NORM))), 0.0, 1.0)
    scored = mean.select(F.col("src").alias("id"), quality.alias("dep_quality"))
    return nodes.select("id").join(scored, "id", "left").fillna(0.0, ["dep_quality"])
