"""Projections, conditional columns and arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, payloads
from ..operators import features
from ..session import cut_lineage
from . import scoring_plan  # noqa: F401  (defines views used below)
from .registry import query
from .views import AS_OF, Tables, with_views

DAYS = "floor((epoch(TIMESTAMP '2005-01-01') - epoch({})) / 86400)"


@query("fill_defaults", with_views("line_counts", """SELECT c_custkey, coalesce(n_r, 0) AS n_r,
  coalesce(n_a, 0) AS n_a FROM customer LEFT JOIN line_counts ON o_custkey = c_custkey"""))
def fill_defaults(t: Tables) -> DataFrame:
    counts = t.lines.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"))
    joined = t.customer.select("c_custkey").join(counts, "c_custkey", "left")
    return features.fill_zero(joined, ["n_r", "n_a"])


@query("unified_count", with_views("base_features", "SELECT id, unified_dep_count FROM base_features"))
def unified_count(t: Tables) -> DataFrame:
    return features.with_unified_count(t.projects).select("id", "unified_dep_count")


@query("ecosystem_scale", with_views("base_features", """SELECT id, round(unified_dep_count * CASE
  WHEN cargo_lock_total_packages > 0 THEN 0.30 WHEN go_sum_unique_modules > 0 THEN 0.40
  WHEN contains(upper(depsdev_ecosystem), 'MAVEN') THEN 0.80 ELSE 1.0 END, 4) AS scaled_dep_count
  FROM base_features"""))
def ecosystem_scale(t: Tables) -> DataFrame:
    return features.with_unified_count(t.projects).select(
        "id", F.round("scaled_dep_count", 4).alias("scaled_dep_count"))


@query("proxy_override", """SELECT s_suppkey, CASE WHEN n = 0 AND n_name = 'NATION_3' THEN 50
  WHEN n = 0 AND n_name = 'NATION_7' THEN 20 WHEN n = 0 AND n_name = 'NATION_12' THEN 0 ELSE n END
  AS count FROM (SELECT s_suppkey, n_name, CASE WHEN s_acctbal < 4000 THEN 0.0::DOUBLE
  ELSE floor(s_acctbal / 1000) END AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey)""")
def proxy_override(t: Tables) -> DataFrame:
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    count = F.when(F.col("s_acctbal") < 4000, 0.0).otherwise(
        F.floor(F.col("s_acctbal") / 1000).cast("double"))
    return named.select("s_suppkey", features.proxy_override(
        count, F.col("n_name"), {"NATION_3": 50, "NATION_7": 20, "NATION_12": 0}).alias("count"))


@query("clip_range", """SELECT c_custkey, greatest(0, least(5000, c_acctbal)) AS both,
  greatest(0, c_acctbal) AS low, least(5000, c_acctbal) AS high FROM customer""")
def clip_range(t: Tables) -> DataFrame:
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", numeric.clip(x, 0.0, 5000.0).alias("both"),
                             numeric.clip(x, low=0.0).alias("low"),
                             numeric.clip(x, high=5000.0).alias("high"))


@query("numeric_coerce", r"""SELECT event_id, coalesce(try_cast(CASE event_type WHEN 'click'
  THEN CAST(value AS VARCHAR) WHEN 'view' THEN 'n/a' WHEN 'error' THEN ''
  ELSE regexp_extract(props, '(\d+)', 1) END AS DOUBLE), 0) AS value FROM events""")
def numeric_coerce(t: Tables) -> DataFrame:
    raw = (F.when(F.col("event_type") == "click", F.col("value").cast("string"))
           .when(F.col("event_type") == "view", "n/a").when(F.col("event_type") == "error", "")
           .otherwise(F.get_json_object("props", "$.k")))
    return t.events.select("event_id", numeric.to_number(raw).alias("value"))


@query("log_norm", """SELECT p_partkey, round(ln(1 + p_retailprice)
  / ln(1 + (SELECT max(p_retailprice) FROM part)), 6) AS score FROM part""")
def log_norm(t: Tables) -> DataFrame:
    best = features.top(t.part, F.col("p_retailprice"))
    return t.part.select("p_partkey", F.round(numeric.log_norm(F.col("p_retailprice"), best), 6)
                         .alias("score"))


@query("sqrt_norm", """SELECT p_partkey, round(sqrt(p_retailprice
  / ((SELECT max(p_retailprice) FROM part) + 1e-9)), 6) AS score FROM part""")
def sqrt_norm(t: Tables) -> DataFrame:
    best = features.top(t.part, F.col("p_retailprice"))
    return t.part.select("p_partkey", F.round(numeric.sqrt_norm(F.col("p_retailprice"), best), 6)
                         .alias("score"))


@query("age_years", f"""SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'P' THEN 1.0
  ELSE greatest({DAYS.format("o_orderdate")} / 365.25, 0.1) END, 6) AS age FROM orders""")
def age_years(t: Tables) -> DataFrame:
    pattern = (F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
               .when(F.col("o_orderkey") % 3 == 1,
                     F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
               .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    text = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(pattern)
    return t.orders.select("o_orderkey", F.round(numeric.age_years(text, AS_OF), 6).alias("age"))


@query("age_adjusted", with_views("base_features", """SELECT id,
  round(age_adj_dep_count, 5) AS age_adj_dep_count FROM base_features"""))
def age_adjusted(t: Tables) -> DataFrame:
    df = features.with_unified_count(features.with_age(t.projects, AS_OF))
    return features.with_age_adjusted(df).select(
        "id", F.round("age_adj_dep_count", 5).alias("age_adj_dep_count"))


@query("derived_ratios", with_views("projects", f"""SELECT id, coalesce({DAYS.format("created")}, 0) AS age_days,
  coalesce({DAYS.format("pushed")}, 0) AS days_since_push,
  round(CAST(CAST(commits_last_year / greatest(stars, 1) AS VARCHAR) AS DECIMAL(38,12)), 4)::DOUBLE AS fork_to_star_ratio,
  round(CAST(CAST(dependency_count / greatest(contributor_count, 1) AS VARCHAR) AS DECIMAL(38,12)), 4)::DOUBLE AS deps_per_src_file,
  round(CAST(CAST(dependency_count / greatest(total_code_bytes / 1000, 1) AS VARCHAR) AS DECIMAL(38,12)), 6)::DOUBLE AS deps_per_1k_loc,
  round(CAST(CAST(contributor_count / greatest(commits_last_year, 1) AS VARCHAR) AS DECIMAL(38,12)), 4)::DOUBLE AS src_to_total_file_ratio,
  round(CAST(CAST(commits_last_year / greatest(contributor_count, 1) AS VARCHAR) AS DECIMAL(38,12)), 2)::DOUBLE AS commits_per_contributor,
  round(CAST(CAST(stars / greatest(contributor_count, 1) AS VARCHAR) AS DECIMAL(38,12)), 2)::DOUBLE AS stars_per_contributor,
  round(CAST(CAST(total_code_bytes / greatest(dependency_count, 1) AS VARCHAR) AS DECIMAL(38,12)), 2)::DOUBLE AS code_bytes_per_dep,
  round(CAST(CAST(commits_last_year / greatest(coalesce({DAYS.format("created")}, 0), 1) AS VARCHAR) AS DECIMAL(38,12)), 4)::DOUBLE
    AS commits_per_age_day FROM projects"""))
def derived_ratios(t: Tables) -> DataFrame:
    wide = t.projects.withColumns({
        "forks_count": F.col("commits_last_year"), "src_file_count": F.col("contributor_count"),
        "total_files": F.col("commits_last_year"), "total_commits": F.col("commits_last_year")})
    return wide.select("id", *[c.alias(n) for n, c in payloads.derived_ratios(AS_OF).items()])


@query("activity_score", with_views("base_features", """SELECT id, round(
  ln(1 + repo_age_years * commits_last_year) / max(ln(1 + repo_age_years * commits_last_year)) OVER (), 5)
  AS activity_score, round(ln(1 + stars) / ln(1 + max(stars) OVER ()), 5) AS star_score
  FROM base_features"""))
def activity_score(t: Tables) -> DataFrame:
    aged = features.with_age(t.projects, AS_OF).select(
        "id", "stars", "commits_last_year", "repo_age_years")
    df = features.with_norms(cut_lineage(aged))
    return df.select("id", F.round("activity_score", 5).alias("activity_score"),
                     F.round("star_score", 5).alias("star_score"))


@query("soft_cap", """SELECT l_orderkey, l_partkey, l_suppkey, round(greatest(0.32,
  CASE WHEN x > cap THEN cap + (x - cap) * 0.40 ELSE x END), 9) AS score FROM (SELECT *,
    l_extendedprice / 80000 AS x, CASE l_returnflag WHEN 'R' THEN 0.5::DOUBLE WHEN 'A' THEN 0.62::DOUBLE
    ELSE 0.78::DOUBLE END AS cap FROM lineitem)""")
def soft_cap(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    cap = F.when(flag == "R", 0.5).when(flag == "A", 0.62).otherwise(0.78)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.round(
        numeric.soft_cap(F.col("l_extendedprice") / 80000, cap), 9).alias("score"))


@query("direct_ratio", with_views("base_features", "SELECT id, round(direct_ratio, 6) AS direct_ratio FROM base_features"))
def direct_ratio(t: Tables) -> DataFrame:
    df = features.with_unified_count(t.projects)
    ratio = features.direct_ratio(F.col("unified_dep_count"), F.col("graph_direct_count"),
                                  F.col("depsdev_direct_deps"))
    return df.select("id", F.round(ratio, 6).alias("direct_ratio"))
