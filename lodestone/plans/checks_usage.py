"""Usage of dependencies in source code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..operators import aggregates, manifests, usage
from .checks_text import BUCKET_SQL, WEIGHT_SQL
from .registry import query
from .views import Tables, VIEWS, quote, sql_list, with_views

FILE_CAP = 12

VIEWS["scanned"] = f"""SELECT *, {WEIGHT_SQL} AS weight, {BUCKET_SQL} AS bucket,
  CASE {BUCKET_SQL} WHEN 'core' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END AS rank FROM {{file_kinds}}
  WHERE language IS NOT NULL AND NOT list_has_any(parts, {sql_list(fixed.SKIP_DIRS)})"""
VIEWS["pairs"] = """SELECT c.repo, c.path, c.language, c.content, d.dep, d.terms
  FROM {code} c JOIN {scanned} s ON s.path = c.path AND s.repo = c.repo JOIN {deps} d ON d.repo = c.repo
  WHERE c.language IN ('python', 'javascript', 'typescript')
    OR len(list_filter(d.terms, lambda x: contains(lower(c.content), lower(x)))) > 0"""


def pattern_sql(pattern: str, family: str) -> str:
    """SQL count of one usage pattern for a term ``t``."""
    hole = "{t}" if "{t}" in pattern else "{p}"
    name = "t"
    if hole == "{p}":
        name = "replace(string_split(t, '/')[-1], '-', '')"
        if family == "javascript":
            name = f"replace({name}, '@', '')"
    pieces = (f" || regexp_escape({name}) || ").join(quote(p) for p in pattern.split(hole))
    count = f"len(regexp_extract_all(content, '(?m)' || {pieces}))"
    return count if hole == "{t}" else f"CASE WHEN length({name}) >= 3 THEN {count} ELSE 0 END"


def family_sql(measure: str) -> str:
    arms, other = [], "0"
    for family, spec in usage.USAGE_PATTERNS.items():
        counts = " + ".join(pattern_sql(p, family) for p in spec.get(measure, [])) or "0"
        languages = [family] + [k for k, v in usage.SAME_FAMILY.items() if v == family]
        if family == "other":
            other = counts
        else:
            arms.append(f"WHEN list_contains({sql_list(languages)}, language) THEN {counts}")
    return f"CASE {' '.join(arms)} ELSE {other} END"


def alias_sql(family: str, index: int) -> str:
    pieces = " || regexp_escape(t) || ".join(
        quote(p) for p in usage.ALIAS_PATTERNS[family][index].split("{t}"))
    found = f"regexp_extract_all(content, '(?m)' || {pieces}, 1)"
    if family == "javascript" and index == 2:
        found = f"list_filter({found}, lambda n: NOT list_contains({sql_list(usage.NOT_ALIASES)}, n))"
    return found


VIEWS["term_rows"] = "SELECT repo, path, language, content, dep, unnest(terms) AS t FROM {pairs}"
VIEWS["alias_rows"] = f"""SELECT repo, path, dep, content, unnest(a) AS a FROM (
  SELECT repo, path, dep, content, CASE WHEN language = 'python'
    THEN list_concat({alias_sql("python", 0)}, {alias_sql("python", 1)})
    WHEN language IN ('javascript', 'typescript') THEN list_concat(list_concat(
      {alias_sql("javascript", 0)}, {alias_sql("javascript", 1)}), {alias_sql("javascript", 2)})
    ELSE [] END AS a FROM {{term_rows}})"""
VIEWS["alias_counts"] = r"""SELECT repo, path, dep, CAST(sum(CASE WHEN length(a) >= 2 THEN
    len(regexp_extract_all(content, '\b' || regexp_escape(a) || '\.\w+')) ELSE 0 END) AS BIGINT) AS n
  FROM {alias_rows} GROUP BY repo, path, dep"""
VIEWS["usage_counts"] = f"""SELECT r.*, r.calls0 + coalesce(a.n, 0) AS calls FROM (
  SELECT repo, path, dep, CAST(sum({family_sql("imports")}) AS BIGINT) AS imports,
    CAST(sum({family_sql("aliases")}) AS BIGINT) AS aliases,
    CAST(sum({family_sql("calls")}) AS BIGINT) AS calls0 FROM {{term_rows}} GROUP BY repo, path, dep) r
  LEFT JOIN {{alias_counts}} a ON a.repo = r.repo AND a.path = r.path AND a.dep = r.dep
  WHERE imports + aliases + calls0 + coalesce(a.n, 0) > 0"""
VIEWS["file_scores"] = """SELECT u.*, s.bucket, s.rank, weight * ln(1 + imports + 2 * aliases
  + 3 * least(calls, 50)) AS score FROM {usage_counts} u
  JOIN {scanned} s ON s.repo = u.repo AND s.path = u.path"""
VIEWS["declared"] = """SELECT d.repo, d.dep, d.terms,
  bool_or(n.dep IS NOT NULL AND NOT n.is_dev) AS in_prod,
  bool_or(n.dep IS NOT NULL AND n.is_dev) AS in_dev
  FROM {deps} d LEFT JOIN {code_names} n ON n.repo = d.repo AND (contains(lower(n.dep), lower(d.dep))
    OR list_contains(list_transform(d.terms, lambda x: translate(lower(x), '-.', '__')),
      translate(lower(n.dep), '-.', '__'))) GROUP BY d.repo, d.dep, d.terms"""


@query("term_prefilter", with_views("pairs", "SELECT repo, path, dep FROM pairs"))
def term_prefilter(t: Tables) -> DataFrame:
    return usage.candidates(t.code, t.deps).select("repo", "path", "dep")


@query("known_search_terms", """SELECT p_partkey, CASE WHEN p_size % 7 = 0
  THEN array_to_string(list_filter([lower(p_brand), 'x', 'io'], lambda t: length(t) >= 2), ',')
  ELSE array_to_string(list_filter([p_type || 'Tool-' || p_partkey], lambda t: length(t) >= 3), ',') END AS terms
  FROM part""")
def known_search_terms(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Acme/"), "p_type", F.lit("Tool-"), F.col("p_partkey"))
    deps = t.part.select("p_partkey", name.alias("dep"), F.lit("Go").alias("language"))
    known = t.part.filter("p_size % 7 = 0").select(
        F.lower(name).alias("slug"),
        F.array(F.lower("p_brand"), F.lit("x"), F.lit("io")).alias("terms"))
    return usage.with_search_terms(deps, known).select(
        "p_partkey", F.array_join("terms", ",").alias("terms"))


@query("capped_files", with_views("scanned", f"""SELECT repo, path, bucket, rn FROM (SELECT *,
  row_number() OVER (PARTITION BY repo ORDER BY rank, path) AS rn FROM scanned) WHERE rn <= {FILE_CAP}"""))
def capped_files(t: Tables) -> DataFrame:
    return usage.capped_files(t.files, FILE_CAP).select(
        "repo", "path", paths.bucket(F.col("path")).alias("bucket"), "rn")


@query("file_counts", with_views("scanned", f"""SELECT repo, least(count(*), {FILE_CAP}) AS file_count,
  greatest(count(*) - {FILE_CAP}, 0) AS skipped FROM scanned GROUP BY repo"""))
def file_counts(t: Tables) -> DataFrame:
    return usage.file_counts(t.files, FILE_CAP)


@query("usage_counts", with_views("usage_counts",
                                  "SELECT repo, path, dep, imports, aliases, calls FROM usage_counts"))
def usage_counts(t: Tables) -> DataFrame:
    return usage.usage_per_file(t.code, t.deps)


@query("alias_calls", with_views("alias_counts", "SELECT repo, path, dep, n FROM alias_counts"))
def alias_calls(t: Tables) -> DataFrame:
    return usage.alias_use(t.code, t.deps)


@query("file_score", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(
  CASE l_returnflag WHEN 'R' THEN 2.0 WHEN 'A' THEN 0.3 ELSE 1.0 END * ln(1 + l_linenumber
  + 2 * (l_linenumber % 3) + 3 * least(l_quantity * 2, 50)) * CASE WHEN l_linestatus = 'O' THEN 0.15 ELSE 1 END,
  5) AS score FROM lineitem""")
def file_score(t: Tables) -> DataFrame:
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    weight = F.when(flag == "R", 2.0).when(flag == "A", 0.3).otherwise(1.0)
    score = usage.file_score(number, number % 3, F.col("l_quantity") * 2, weight,
                             F.col("l_linestatus") == "O")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                             F.round(score, 5).alias("score"))


@query("manifest_match", with_views("declared", """SELECT repo, dep, in_prod, in_dev,
  in_prod OR in_dev AS manifest_match, in_dev AND NOT in_prod AS dev_only,
  (CASE WHEN in_prod THEN 3.0 WHEN in_dev THEN 0.9 ELSE 0.0 END)::DOUBLE AS bonus FROM declared"""))
def manifest_match(t: Tables) -> DataFrame:
    names = manifests.extract_all(t.code_manifests)
    return manifests.with_bonus(manifests.match_declared(t.deps, names)).drop("terms")


@query("usage_scores", with_views("file_scores declared scanned", f"""SELECT repo, dep AS dependency,
  round(CASE WHEN calls > 5 AND test_calls / calls > 0.80 THEN 0.5 ELSE 1 END * (bonus + score), 4)
    AS weighted_score, manifest_match, score > 0 AS source_match, total_imports, calls AS total_calls,
  file_count FROM (SELECT d.repo, d.dep, in_prod OR in_dev AS manifest_match,
    CASE WHEN in_prod THEN 3.0 WHEN in_dev THEN 0.9 ELSE 0.0 END AS bonus,
    coalesce(sum(score), 0) * CASE WHEN in_dev AND NOT in_prod THEN 0.15 ELSE 1 END AS score,
    CAST(coalesce(sum(imports), 0) AS BIGINT) AS total_imports,
    CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls,
    CAST(coalesce(sum(calls) FILTER (bucket = 'test'), 0) AS BIGINT) AS test_calls,
    coalesce(any_value(n.file_count), 0) AS file_count
    FROM declared d LEFT JOIN file_scores f
      ON f.repo = d.repo AND f.dep = d.dep
    LEFT JOIN (SELECT repo, count(*) AS file_count FROM scanned GROUP BY repo) n
      ON n.repo = d.repo GROUP BY d.repo, d.dep, in_prod, in_dev)"""))
def usage_scores(t: Tables) -> DataFrame:
    names = manifests.extract_all(t.code_manifests)
    found = usage.usage_scores(t.code, t.deps, names)
    return found.withColumn("weighted_score", F.round("weighted_score", 4))


@query("usage_signal", with_views("usage_signal", """SELECT id AS repo, round(usage_signal, 5)
  AS usage_signal FROM usage_signal"""))
def usage_signal(t: Tables) -> DataFrame:
    return aggregates.usage_signal(t.usage).select(
        "repo", F.round("usage_signal", 5).alias("usage_signal"))
