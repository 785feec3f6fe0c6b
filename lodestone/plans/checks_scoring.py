"""Graph, score, ensemble and tuning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, graph, ranking, scoring, tuning
from ..session import cut_lineage
from . import scoring_plan as plan
from .registry import query
from .views import Tables, with_views


@query("inbound_degree", with_views("inbound", "SELECT id, inbound FROM inbound"))
def inbound_degree(t: Tables) -> DataFrame:
    return graph.inbound_degree(t.edges, t.nodes)


@query("producer_score", with_views("producer", """SELECT id, round(producer, 4) AS producer_score
  FROM producer"""))
def producer_score(t: Tables) -> DataFrame:
    return graph.producer_score(t.edges, t.nodes)


@query("producer_score_3", with_views("weighted known_edges nodes", """, third AS (
  SELECT dst AS id, sum(sqrt(w / ((SELECT max(w) FROM weighted) + 1e-9))) AS w
  FROM known_edges JOIN weighted ON id = src GROUP BY dst)
  SELECT n.id, round(sqrt(coalesce(w, 0) / ((SELECT max(w) FROM third) + 1e-9)), 4) AS producer_score
  FROM nodes n LEFT JOIN third ON third.id = n.id"""))
def producer_score_3(t: Tables) -> DataFrame:
    return graph.producer_score(t.edges, t.nodes, passes=3)


@query("top_producers", with_views("producer", """SELECT id, round(producer, 4) AS producer_score
  FROM producer ORDER BY round(producer, 4) DESC, id LIMIT 8"""))
def top_producers(t: Tables) -> DataFrame:
    return ranking.best(graph.producer_score(t.edges, t.nodes), "producer_score", "id", 8)


@query("consumer_score", with_views("consumer", """SELECT id, round(consumer, 4) AS consumer_score
  FROM consumer"""))
def consumer_score(t: Tables) -> DataFrame:
    base = plan.base_features(t).select("id", "age_adj_dep_count")
    return graph.consumer_score(cut_lineage(base))


@query("pc_ratio", with_views("producer_consumer", "SELECT * FROM producer_consumer"))
def pc_ratio(t: Tables) -> DataFrame:
    base = plan.base_features(t).select("id", "age_adj_dep_count")
    return graph.producer_consumer(t.edges, cut_lineage(base))


@query("dep_quality", with_views("edges nodes", """, degree AS (SELECT src, count(*) AS n FROM edges GROUP BY src)
  SELECT id, round(coalesce(q, 0), 5) AS dep_quality FROM nodes LEFT JOIN (SELECT e.src,
    least(1.0, ln(1 + avg(coalesce(d.n, 0))) / ln(501)) AS q FROM edges e
    LEFT JOIN degree d ON d.src = e.dst GROUP BY e.src) s ON s.src = id"""))
def dep_quality(t: Tables) -> DataFrame:
    return graph.neighbour_quality(t.edges, t.nodes).select(
        "id", F.round("dep_quality", 5).alias("dep_quality"))


@query("base_score", with_views("features", f"""SELECT id, round({plan.base_score_sql()}, 5) AS base
  FROM features"""))
def base_score(t: Tables) -> DataFrame:
    df = plan.features(t).withColumn("base", scoring.base_score())
    config = F.when(F.col("category") == "config_infra", 0.08).otherwise(0.0)
    return df.select("id", F.round(F.col("base") - config, 5).alias("base"))


@query("capped_score", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  {plan.capped_sql("base", "cap")} AS score FROM (SELECT *,
    x - CASE WHEN category = 'config_infra' THEN 0.08 ELSE 0 END AS base,
    ({plan.CAP_SQL})::DOUBLE AS cap FROM (SELECT *, ln(1 + l_extendedprice) / 12 AS x,
      CASE l_linenumber WHEN 1 THEN 'data_repo' WHEN 2 THEN 'config_infra' WHEN 3 THEN 'dev_tooling'
      WHEN 4 THEN 'general' WHEN 5 THEN 'zk_system' ELSE 'unknown' END AS category FROM lineitem))""")
def capped_score(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    category = (F.when(n == 1, "data_repo").when(n == 2, "config_infra").when(n == 3, "dev_tooling")
                .when(n == 4, "general").when(n == 5, "zk_system").otherwise("unknown"))
    rows = t.lineitem.withColumn("category", category)
    score = scoring.capped(F.log1p("l_extendedprice") / 12, scoring.category_cap())
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", score.alias("score"))


@query("originality_pipeline", with_views("scored", "SELECT id, category, originality FROM scored"))
def originality_pipeline(t: Tables) -> DataFrame:
    return plan.originality(t).select("id", "category", "originality")


@query("score_report", with_views("report", "SELECT * FROM report"))
def score_report(t: Tables) -> DataFrame:
    return scoring.score_report(plan.originality(t))


@query("tuned_pipeline", with_views("tuned_scored", "SELECT id, category, originality FROM tuned_scored"))
def tuned_pipeline(t: Tables) -> DataFrame:
    return plan.tuned_originality(t).select("id", "category", "originality")


TERMS_SQL = {
    "dep_score": "0.35 * dep_score", "code_score": "0.22 * code_score",
    "contrib_score": "0.06 * contrib_score", "category_bonus": "cat_bonus",
    "readme_bonus": "greatest(-0.06, least(0.06, readme_tech_signal * 0.02))",
    "benchmark_bonus": "CASE WHEN has_benchmarks THEN 0.02 ELSE 0 END",
    "star_score": "0.05 * star_score", "activity_score": "0.04 * activity_score",
    "usage_signal": "-0.03 * usage_signal", "producer_score": "0.04 * producer_score",
    "consumer_score": "-0.04 * consumer_score", "pc_ratio": "0.02 * pc_ratio",
    "signals": """greatest(-0.15, least(0.15, 0.06 * ai_scratch + 0.04 * ai_protocol + 0.03 * ai_novel
      + 0.08 * ai_found - 0.10 * ai_wrapper - 0.04 * ai_template))""",
}


@query("mean_contribution", with_views("features", " UNION ALL ".join(
    f"SELECT '{n}' AS term, round(avg({e}), 6) AS mean_contribution FROM features"
    for n, e in TERMS_SQL.items())))
def mean_contribution(t: Tables) -> DataFrame:
    found = aggregates.mean_contributions(plan.features(t), scoring.score_terms())
    return found.withColumn("mean_contribution", F.round("mean_contribution", 6))


# ---- ensemble ----------------------------------------------------------------------------

@query("ensemble_vote", """SELECT user_id, event_type, round(avg(value), 9) AS mean_vote,
  count(*) FILTER (value >= 50) * 2 > count(value) AS majority FROM events
  GROUP BY user_id, event_type""")
def ensemble_vote(t: Tables) -> DataFrame:
    return scoring.ensemble_vote(t.events, "user_id", "event_type", "value", 50.0).withColumn(
        "mean_vote", F.round("mean_vote", 9))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("ensemble_wide", "SELECT user_id, " + ", ".join(
    f"round(avg(value) FILTER (event_type = '{k}'), 9) AS \"{k}\"" for k in KINDS)
    + " FROM events GROUP BY user_id")
def ensemble_wide(t: Tables) -> DataFrame:
    votes = scoring.ensemble_vote(t.events, "user_id", "event_type", "value", 50.0)
    wide = scoring.ensemble_wide(votes, "user_id", "event_type", KINDS)
    return wide.select("user_id", *[F.round(k, 9).alias(k) for k in KINDS])


@query("ensemble_agreement", """SELECT event_type, round(avg(a), 6) AS agreement, count(*) AS items
  FROM (SELECT user_id, event_type, greatest(count(*) FILTER (value >= 50),
    count(*) FILTER (value < 50)) / count(*) AS a FROM events GROUP BY user_id, event_type)
  GROUP BY event_type""")
def ensemble_agreement(t: Tables) -> DataFrame:
    return scoring.ensemble_agreement(t.events, "user_id", "event_type", "value", 50.0).withColumn(
        "agreement", F.round("agreement", 6))


# ---- tuning ------------------------------------------------------------------------------

@query("param_grid", with_views("model_errors models", """SELECT m * 4 + u AS combo_id,
  round(dep_w, 2)::DOUBLE AS dep_weight, round(wrap_w, 2)::DOUBLE AS wrapper_coef, round(cap_w, 2)::DOUBLE AS cap,
  round(-0.06 + u * 0.02, 2)::DOUBLE AS usage_weight, round(error / n / 1000000, 6) AS mae
  FROM model_errors JOIN models USING (m), (SELECT unnest([0, 1, 2, 3]) AS u)"""))
def param_grid(t: Tables) -> DataFrame:
    errors = tuning.grid_errors(plan.anchor_features(t))
    return tuning.with_mae(errors).withColumn("mae", F.round("mae", 6))


@query("grid_search", with_views("grid_best", """SELECT m * 4 AS combo_id,
  round(dep_w, 2)::DOUBLE AS dep_weight, round(wrap_w, 2)::DOUBLE AS wrapper_coef, round(cap_w, 2)::DOUBLE AS cap,
  -0.06::DOUBLE AS usage_weight, round(error / n / 1000000, 6) AS mae FROM grid_best"""))
def grid_search(t: Tables) -> DataFrame:
    return tuning.grid_search(plan.anchor_features(t)).withColumn("mae", F.round("mae", 6))


def fitted(t: Tables) -> tuple[DataFrame, dict, dict]:
    """Anchors and the grid's best weights and caps."""
    anchors = cut_lineage(plan.anchor_features(t))
    best = tuning.grid_search(anchors).first()
    weights = dict(scoring.fixed.WEIGHTS, dep_weight=best["dep_weight"],
                   ai_wrapper_coef=best["wrapper_coef"])
    return anchors, weights, tuning.grid_caps(best["cap"])


@query("cap_search", with_views("cap_best", """SELECT combo_id, zk_system, dev_tooling, config_infra,
  crypto_primitive, round(error / n / 1000000, 6) AS mae FROM cap_best"""))
def cap_search(t: Tables) -> DataFrame:
    return tuning.cap_search(*fitted(t)).withColumn("mae", F.round("mae", 6))


@query("leave_two_out", with_views("cv", "SELECT pairs, round(cv_mae, 6) AS cv_mae FROM cv"))
def leave_two_out(t: Tables) -> DataFrame:
    anchors = cut_lineage(plan.anchor_features(t))
    weights, caps = tuning.tune(anchors)
    return tuning.leave_two_out(anchors, weights, caps).withColumn("cv_mae", F.round("cv_mae", 6))


@query("overfit_gap", with_views("cv cap_best", """SELECT round(cv_mae, 6) AS cv_mae,
  round(error / n / 1000000, 6) AS train_mae, round(cv_mae - error / n / 1000000, 6) AS gap,
  cv_mae - error / n / 1000000 > 0.04 AS overfit FROM cv, cap_best"""))
def overfit_gap(t: Tables) -> DataFrame:
    anchors, weights, caps = fitted(t)
    refined = tuning.cap_search(anchors, weights, caps).first()
    caps = dict(caps, **{name: refined[name] for name in scoring.fixed.CAP_AXES})
    held = tuning.leave_two_out(anchors, weights, caps)
    train = F.lit(refined["mae"])
    found = tuning.overfit_gap(F.col("cv_mae"), train)
    return held.select(F.round("cv_mae", 6).alias("cv_mae"), F.round(train, 6).alias("train_mae"),
                       F.round(found["gap"], 6).alias("gap"), found["overfit"].alias("overfit"))
