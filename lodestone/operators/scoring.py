"""The originality score and the votes that feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import CODE_NORM_LOG, clip, lookup, soft_cap, total

SIGNAL_WEIGHTS = {
    "ai_scratch": "ai_scratch_coef",
    "ai_protocol": "ai_protocol_coef",
    "ai_novel": "ai_novel_coef",
    "ai_found": "ai_found_coef",
    "ai_wrapper": "ai_wrapper_coef",
    "ai_template": "ai_template_coef",
}
EXTRA_WEIGHTS = {
    "star_score": "star_weight",
    "activity_score": "activity_weight",
    "usage_signal": "usage_weight",
    "producer_score": "producer_weight",
    "consumer_score": "consumer_weight",
    "pc_ratio": "pc_ratio_weight",
}


def weight(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def with_core_scores(df: DataFrame) -> DataFrame:
    """Dependency, code and contributor scores. The two table-wide maxima are one value of
    one subquery."""
    tops = df.agg(F.struct(
        F.max("age_adj_dep_count").alias("dep"),
        F.max(F.nullif(F.col("contributor_count"), F.lit(0))).alias("contrib")).alias("t")
    ).scalar()
    dep_top = F.log1p(F.greatest(tops["dep"], F.lit(fixed.DEP_NORM_FLOOR)))
    contrib_top = F.log1p(F.coalesce(tops["contrib"], F.lit(1)))

    def present(name):
        return F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0))

    return df.withColumns({
        "dep_score": F.lit(1.0) - F.log1p(present("age_adj_dep_count")) / dep_top,
        "code_score": F.log1p(present("total_code_bytes")) / F.lit(CODE_NORM_LOG),
        "contrib_score": F.log1p(present("contributor_count")) / contrib_top,
    })


def signal_sum(weights: dict) -> Column:
    """Weighted model signals, bounded together."""
    parts = [weight(weights[w]) * F.coalesce(F.col(c), F.lit(0.0))
             for c, w in SIGNAL_WEIGHTS.items()]
    return clip(total(parts), -fixed.SIGNAL_LIMIT, fixed.SIGNAL_LIMIT)


def score_terms(weights: dict = fixed.WEIGHTS) -> dict[str, Column]:
    """Every term of the raw score by name."""
    readme = clip(F.coalesce(F.col("readme_tech_signal"), F.lit(0)) * F.lit(fixed.README_STEP),
                  -fixed.README_LIMIT, fixed.README_LIMIT)
    bench = F.when(F.col("has_benchmarks"), F.lit(fixed.BENCH_BONUS)).otherwise(F.lit(0.0))
    terms = {
        "dep_score": weight(weights["dep_weight"]) * F.col("dep_score"),
        "code_score": weight(weights["code_weight"]) * F.col("code_score"),
        "contrib_score": weight(weights["contrib_weight"]) * F.col("contrib_score"),
        "category_bonus": F.coalesce(F.col("cat_bonus"), F.lit(0.0)),
        "readme_bonus": readme,
        "benchmark_bonus": bench,
        "signals": signal_sum(weights),
    }
    for column, name in EXTRA_WEIGHTS.items():
        terms[column] = weight(weights[name]) * F.coalesce(F.col(column), F.lit(0.0))
    return terms


def base_score(weights: dict = fixed.WEIGHTS) -> Column:
    """Score before any cap."""
    raw = total(list(score_terms(weights).values()))
    return F.lit(fixed.SCORE_BASE) + raw / F.lit(fixed.SCORE_DIVISOR) * F.lit(fixed.SCORE_SPAN)


def category_cap(caps: dict = fixed.CATEGORY_CAPS) -> Column:
    return lookup(F.col("category"), {k: float(v) for k, v in caps.items()}, fixed.DEFAULT_CAP)


def capped(base: Column, cap: Column, category: Column | None = None) -> Column:
    """Config projects lose a fixed amount first; then the soft cap, rounded to 3 digits."""
    category = F.col("category") if category is None else category
    lowered = F.when(category == "config_infra",
                     base - F.lit(fixed.CONFIG_PENALTY)).otherwise(base)
    return F.round(soft_cap(lowered, cap), 3)


def scored(df: DataFrame, weights: dict = fixed.WEIGHTS,
           caps: dict = fixed.CATEGORY_CAPS) -> DataFrame:
    """Adds ``originality`` to a table of finished features."""
    return df.withColumn("originality", capped(base_score(weights), category_cap(caps)))


def score_report(df: DataFrame) -> DataFrame:
    """The 15 diagnostic columns."""
    def short(name, digits=3, default=0.0):
        return F.round(F.coalesce(F.col(name), F.lit(default)), digits).alias(name)

    return df.select(
        F.col("repo_url").alias("repo"), "originality", "category",
        F.col("unified_dep_count").cast("bigint").alias("dep_count"),
        F.round(F.coalesce("repo_age_years", F.lit(0.0)), 1).alias("age_years"),
        F.round(F.coalesce("age_adj_dep_count", F.lit(0.0)), 1).alias("age_adj_deps"),
        short("producer_score"), short("consumer_score"), short("pc_ratio"),
        short("direct_ratio", default=1.0), short("usage_signal"), short("star_score"),
        F.floor(F.coalesce("total_code_bytes", F.lit(0)) / 1000).cast("bigint").alias("code_kb"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce("stars", F.lit(0)).cast("bigint").alias("stars"))


def submission(report: DataFrame) -> DataFrame:
    return report.select("repo", F.round("originality", 4).alias("originality"))


def ensemble_vote(verdicts: DataFrame, item: str, signal: str, value: str, cut: float = 0.5
                  ) -> DataFrame:
    """Mean of the models' verdicts per item and signal, and the majority vote."""
    yes = F.count_if(F.col(value) >= cut)
    return verdicts.groupBy(item, signal).agg(
        F.avg(value).alias("mean_vote"), (yes * 2 > F.count(value)).alias("majority"))


def ensemble_wide(votes: DataFrame, item: str, signal: str, signals: list[str]) -> DataFrame:
    """One column per signal. The signals are named, so no pass is spent finding them."""
    return votes.groupBy(item).pivot(signal, signals).agg(F.max("mean_vote"))


def ensemble_agreement(verdicts: DataFrame, item: str, signal: str, value: str,
                       cut: float = 0.5) -> DataFrame:
    """Per signal, the mean share of models that side with the larger camp."""
    yes = F.count_if(F.col(value) >= cut)
    n = F.count(value)
    per_item = verdicts.groupBy(item, signal).agg(
        (F.greatest(yes, n - yes) / n).alias("agreement"))
    return per_item.groupBy(signal).agg(F.avg("agreement").alias("agreement"),
                                        F.count(F.lit(1)).alias("items"))
