"""From source tables to scores: the whole pipeline over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import axis
from ..functions.text import classify, readme_signal
from ..operators.aggregates import usage_signal
from ..operators.features import (
    direct_ratio, with_age, with_age_adjusted, with_signals, with_unified_count,
)
from ..operators.pipeline import finished, fitted
from ..operators.scoring import scored
from ..session import cut_lineage
from .views import AS_OF, HIGH, LOW, NAMED, RULES, VIEWS, Tables, quote, sql_list


def base_features(t: Tables) -> DataFrame:
    """Per-project features that need no table-wide maximum. Texts end here."""
    df = with_age(t.projects, AS_OF)
    df = with_age_adjusted(with_unified_count(df))
    df = df.withColumn("direct_ratio", direct_ratio(
        F.col("unified_dep_count"), F.col("graph_direct_count"), F.col("depsdev_direct_deps")))
    df = df.withColumn("readme_tech_signal", readme_signal(F.col("description"), HIGH, LOW))
    kind = classify(F.col("repo_name"), F.col("description"), F.lit(""), F.col("language"),
                    RULES, NAMED)
    df = df.withColumn("kind", kind).withColumns({
        "category": F.col("kind.category"), "cat_bonus": F.col("kind.bonus")})
    return df.drop("description", "kind")


def features(t: Tables) -> DataFrame:
    """Finished features. The joined lines that projects, usage and edges come from are
    written once. So is the base table, narrow and without texts; the table-wide maxima and
    the graph passes read it from there."""
    t.settle_lines()
    users = t.events.agg((F.max("user_id") + 1).alias("n")).scalar()
    base = base_features(t).withColumn("user_id", F.col("id") % users)
    base = with_signals(base, t.signals, "user_id").drop("user_id")
    rolled = usage_signal(t.usage).withColumnRenamed("repo", "id")
    base = base.join(rolled, "id", "left").fillna(0.0, ["usage_signal"])
    base = cut_lineage(base)
    return finished(base, t.edges)


def anchor_features(t: Tables) -> DataFrame:
    return features(t).join(t.anchors, "id")


def originality(t: Tables) -> DataFrame:
    return scored(features(t))


def tuned_originality(t: Tables) -> DataFrame:
    """Scores under weights and caps fitted to the anchors first."""
    table = cut_lineage(features(t))
    return fitted(table, table.join(t.anchors, "id"))


def rule_sql(text: str, language: str, name: str, what: int) -> str:
    """CASE over the named projects and the rules; ``what`` 0 gives the category, 1 the bonus."""
    def value(category, bonus):
        return quote(category) if what == 0 else str(bonus)

    arms = [f"WHEN list_contains({sql_list(names)}, {name}) THEN {value(c, '0.0')}"
            for c, names in NAMED.items()]
    for category, bonus, phrases, languages in RULES:
        hit = "(" + " OR ".join(f"contains({text}, {quote(p)})" for p in phrases) + ")"
        if languages:
            hit += f" AND list_contains({sql_list(languages)}, {language})"
        arms.append(f"WHEN {hit} THEN {value(category, bonus)}")
    return "CASE " + " ".join(arms) + f" ELSE {value('general', '0.0')} END"


def hits_sql(text: str, phrases) -> str:
    return "(" + " + ".join(f"contains({text}, {quote(p)})::INT" for p in phrases) + ")"


VIEWS["base_features"] = f"""SELECT *, unified_dep_count * CASE
    WHEN cargo_lock_total_packages > 0 THEN 0.30::DOUBLE
    WHEN go_sum_unique_modules > 0 THEN 0.40::DOUBLE
    WHEN contains(upper(depsdev_ecosystem), 'MAVEN') THEN 0.80::DOUBLE ELSE 1.0::DOUBLE END
      / ln(1 + least(repo_age_years, 7.0::DOUBLE)) AS age_adj_dep_count,
    CASE WHEN unified_dep_count = 0 THEN 1.0
      ELSE least(1.0, coalesce(graph_direct_count, depsdev_direct_deps) / unified_dep_count) END AS direct_ratio
  FROM (SELECT *,
    CAST(CASE WHEN graph_dep_count > 0 THEN graph_dep_count
      WHEN cargo_lock_total_packages > 0 THEN cargo_lock_total_packages
      WHEN go_sum_unique_modules > 0 THEN go_sum_unique_modules
      WHEN depsdev_transitive_deps > 0 THEN depsdev_transitive_deps
      ELSE dependency_count END AS DOUBLE) AS unified_dep_count,
    coalesce(greatest(floor((epoch(TIMESTAMP '2005-01-01') - epoch(created)) / 86400) / 365.25, 0.1),
      1.0)::DOUBLE AS repo_age_years,
    greatest(-3, least(5, {hits_sql("lower(coalesce(description, ''))", HIGH)}
      - {hits_sql("lower(coalesce(description, ''))", LOW)})) AS readme_tech_signal,
    {rule_sql("lower(coalesce(description, ''))", "language", "repo_name", 0)} AS category,
    {rule_sql("lower(coalesce(description, ''))", "language", "repo_name", 1)}::DOUBLE AS cat_bonus
    FROM {{projects}})"""
VIEWS["usage_signal"] = """SELECT repo AS id, 0.5 * n_source / n + 0.5 * least(1.0,
    ln(1 + total / n) / ln(1 + max(total / n) OVER () + 1e-9)) AS usage_signal
  FROM (SELECT repo, count(dependency) AS n, count(*) FILTER (source_match) AS n_source,
    sum(weighted_score) AS total FROM {usage} GROUP BY repo)"""
VIEWS["inbound"] = """SELECT id, count(src) AS inbound FROM {nodes}
  LEFT JOIN {known_edges} ON dst = id GROUP BY id"""
VIEWS["producer"] = """SELECT n.id, sqrt(coalesce(w, 0) / ((SELECT max(w) FROM weighted) + 1e-9)) AS producer
  FROM {nodes} n LEFT JOIN weighted ON weighted.id = n.id""".replace("weighted", "{weighted}")
VIEWS["weighted"] = """SELECT dst AS id, sum(sqrt(inbound / ((SELECT max(inbound) FROM {inbound}) + 1e-9))) AS w
  FROM {known_edges} JOIN {inbound} ON id = src GROUP BY dst"""
VIEWS["consumer"] = """SELECT id, ln(1 + age_adj_dep_count)
  / (ln(1 + (SELECT max(age_adj_dep_count) FROM {base_features})) + 1e-9) AS consumer
  FROM {base_features}"""
VIEWS["producer_consumer"] = """SELECT id, round(producer, 4) AS producer_score,
  round(consumer, 4) AS consumer_score,
  round(ratio / (max(ratio) OVER () + 1e-9), 4) AS pc_ratio
  FROM (SELECT *, producer / (consumer + 0.1) AS ratio FROM {producer} JOIN {consumer} USING (id))"""
VIEWS["features"] = """SELECT b.*, coalesce(usage_signal, 0) AS usage_signal,
  producer_score, consumer_score, pc_ratio,
  coalesce(implements_from_scratch, 0) AS ai_scratch,
  coalesce(defines_new_protocol, 0) AS ai_protocol,
  coalesce(has_novel_algorithms, 0) AS ai_novel,
  coalesce(is_wrapper_or_integration, 0) AS ai_wrapper, 0.0 AS ai_found,
  coalesce(is_template_or_scaffold, 0) AS ai_template,
  coalesce(ln(1 + stars) / ln(1 + max(stars) OVER ()), 0) AS star_score,
  coalesce(ln(1 + repo_age_years * commits_last_year)
    / max(ln(1 + repo_age_years * commits_last_year)) OVER (), 0) AS activity_score,
  1 - ln(1 + age_adj_dep_count) / ln(1 + greatest(max(age_adj_dep_count) OVER (), 400)) AS dep_score,
  ln(1 + total_code_bytes) / ln(1 + 58165882) AS code_score,
  ln(1 + contributor_count) / ln(1 + max(contributor_count) OVER ()) AS contrib_score
  FROM {base_features} b LEFT JOIN {usage_signal} u ON u.id = b.id
  JOIN {producer_consumer} pc ON pc.id = b.id
  LEFT JOIN {signals} s ON s.user_id = b.id % (SELECT max(user_id) + 1 FROM events)"""


def base_score_sql(dep="0.35", wrapper="-0.10") -> str:
    return f"""0.35 + ({dep} * dep_score + 0.22 * code_score + 0.06 * contrib_score + cat_bonus
    + greatest(-0.06, least(0.06, readme_tech_signal * 0.02))
    + CASE WHEN has_benchmarks THEN 0.02 ELSE 0 END
    + greatest(-0.15, least(0.15, 0.06 * ai_scratch + 0.04 * ai_protocol + 0.03 * ai_novel
      + 0.08 * ai_found + {wrapper} * ai_wrapper - 0.04 * ai_template))
    + 0.05 * star_score + 0.04 * activity_score - 0.03 * usage_signal + 0.04 * producer_score
    - 0.04 * consumer_score + 0.02 * pc_ratio)::DOUBLE / 0.75 * 0.55
    - CASE WHEN category = 'config_infra' THEN 0.08 ELSE 0 END"""


CAP_SQL = "CASE category " + " ".join(
    f"WHEN {quote(k)} THEN {v}" for k, v in fixed.CATEGORY_CAPS.items()) + " ELSE 0.85 END"


def capped_sql(base: str, cap: str) -> str:
    return f"""round(greatest(0.32, CASE WHEN {base} > {cap}
      THEN {cap} + ({base} - {cap}) * 0.40 ELSE {base} END)::DOUBLE, 3)"""


VIEWS["scored"] = f"""SELECT *, {capped_sql("base", "cap")} AS originality
  FROM (SELECT *, {base_score_sql()} AS base, ({CAP_SQL})::DOUBLE AS cap FROM {{features}})"""
VIEWS["report"] = """SELECT repo_url AS repo, originality, category,
  CAST(unified_dep_count AS BIGINT) AS dep_count, round(repo_age_years, 1) AS age_years,
  round(age_adj_dep_count, 1) AS age_adj_deps, round(CAST(CAST(producer_score AS VARCHAR) AS DECIMAL(18,9)), 3)::DOUBLE AS producer_score,
  round(CAST(CAST(consumer_score AS VARCHAR) AS DECIMAL(18,9)), 3)::DOUBLE AS consumer_score, round(CAST(CAST(pc_ratio AS VARCHAR) AS DECIMAL(18,9)), 3)::DOUBLE AS pc_ratio,
  round(direct_ratio, 3) AS direct_ratio, round(usage_signal, 3) AS usage_signal,
  round(star_score, 3) AS star_score, total_code_bytes // 1000 AS code_kb,
  coalesce(language, '') AS language, stars FROM {scored}"""
VIEWS["anchor_rows"] = "SELECT f.*, target FROM {features} f JOIN {anchors} a ON a.id = f.id"

GRID_CAPS = sql_list(fixed.GRID_CAP_CATEGORIES)
VIEWS["models"] = """SELECT m, 0.25 + (m // 30) * 0.03 AS dep_w, -0.12 + ((m // 6) % 5) * 0.02 AS wrap_w,
  0.72 + (m % 6) * 0.02 AS cap_w FROM (SELECT unnest(generate_series(0, 299)) AS m)"""
VIEWS["model_errors"] = f"""SELECT m, CAST(sum(round(abs({capped_sql("base", "cap")} - target) * 1000000))
    AS BIGINT) AS error, count(*) AS n
  FROM (SELECT m, target, {base_score_sql("dep_w::DOUBLE", "wrap_w::DOUBLE")} AS base,
    (CASE WHEN list_contains({GRID_CAPS}, category) THEN cap_w ELSE {CAP_SQL} END)::DOUBLE AS cap
    FROM {{anchor_rows}}, {{models}}) GROUP BY m"""
VIEWS["grid_best"] = """SELECT * FROM {model_errors} JOIN {models} USING (m) ORDER BY error, m LIMIT 1"""


def cap_axis_sql(name: str) -> str:
    return "[" + ", ".join(f"{v:.2f}" for v in axis(*fixed.CAP_AXES[name])) + "]"


VIEWS["tuned_base"] = f"""SELECT category, target, {base_score_sql("dep_w::DOUBLE", "wrap_w::DOUBLE")} AS base,
  (CASE WHEN list_contains({GRID_CAPS}, category) THEN cap_w ELSE {CAP_SQL} END)::DOUBLE AS cap
  FROM {{anchor_rows}}, {{grid_best}}"""
VIEWS["cap_points"] = " UNION ALL ".join(
    f"SELECT '{c}' AS category, i - 1 AS i, ({cap_axis_sql(c)}[i])::DOUBLE AS v "
    f"FROM (SELECT unnest(generate_series(1, {spec[2]})) AS i)"
    for c, spec in fixed.CAP_AXES.items())
VIEWS["cap_errors"] = f"""SELECT p.category, p.i, p.v, CAST(coalesce(sum(round(abs(
    {capped_sql("base", "p.v")} - target) * 1000000)), 0) AS BIGINT) AS error
  FROM {{cap_points}} p LEFT JOIN {{tuned_base}} b ON b.category = p.category
  GROUP BY p.category, p.i, p.v"""
VIEWS["rest_error"] = f"""SELECT CAST(coalesce(sum(round(abs({capped_sql("base", "cap")} - target)
    * 1000000)) FILTER (NOT list_contains({sql_list(fixed.CAP_AXES)}, category)), 0) AS BIGINT)
    AS rest, count(*) AS n FROM {{tuned_base}}"""
VIEWS["cap_combos"] = """SELECT z.i * 576 + d.i * 72 + c.i * 9 + p.i AS combo_id,
  z.v AS zk_system, d.v AS dev_tooling, c.v AS config_infra, p.v AS crypto_primitive,
  r.rest + z.error + d.error + c.error + p.error AS error, r.n
  FROM {rest_error} r, {cap_errors} z, {cap_errors} d, {cap_errors} c, {cap_errors} p
  WHERE z.category = 'zk_system' AND d.category = 'dev_tooling'
    AND c.category = 'config_infra' AND p.category = 'crypto_primitive'"""
VIEWS["cap_best"] = "SELECT * FROM {cap_combos} ORDER BY error, combo_id LIMIT 1"
TUNED_CAP = """(CASE category WHEN 'zk_system' THEN cb.zk_system WHEN 'dev_tooling' THEN cb.dev_tooling
  WHEN 'config_infra' THEN cb.config_infra WHEN 'crypto_primitive' THEN cb.crypto_primitive
  WHEN 'data_repo' THEN 0.50 ELSE gb.cap_w END)::DOUBLE"""
VIEWS["tuned_scored"] = f"""SELECT *, {capped_sql("base", "cap")} AS originality FROM (
  SELECT f.*, {base_score_sql("gb.dep_w::DOUBLE", "gb.wrap_w::DOUBLE")} AS base, {TUNED_CAP} AS cap
  FROM {{features}} f, {{grid_best}} gb, {{cap_best}} cb)"""
VIEWS["cv_errors"] = f"""SELECT g, i, CAST(round(abs({capped_sql("base", "cap")} - target) * 1000000)
    AS BIGINT) AS e
  FROM (SELECT g, a.id AS i, target,
    {base_score_sql("(0.28 + (g // 3) * 0.06)::DOUBLE", "(-0.12 + (g % 3) * 0.04)::DOUBLE")} AS base,
    {TUNED_CAP} AS cap
    FROM {{anchor_rows}} a, {{grid_best}} gb, {{cap_best}} cb,
      (SELECT unnest(generate_series(0, 11)) AS g))"""
VIEWS["cv"] = """SELECT count(*) AS pairs, avg((ei + ej) / 2.0) / 1000000 AS cv_mae FROM (
  SELECT a.i, b.i AS j, arg_min(a.e, (s.total - a.e - b.e) * 100 + a.g) AS ei,
    arg_min(b.e, (s.total - a.e - b.e) * 100 + a.g) AS ej
  FROM {cv_errors} a JOIN {cv_errors} b ON a.g = b.g AND a.i < b.i
  JOIN (SELECT g, sum(e) AS total FROM {cv_errors} GROUP BY g) s ON s.g = a.g GROUP BY a.i, b.i)"""
