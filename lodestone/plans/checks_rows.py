"""Wide project rows from landed payloads, and containment with a large dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import containment, project_row
from ..session import cut_lineage
from .checks_text import ext_sql
from .registry import query
from .scoring_plan import hits_sql
from .views import AS_OF, Tables, VIEWS, quote, with_views

PROJECTS = 211
URL_SQL = f"'https://github.com/Own' || (p % 7) || '/Proj-' || p"

# Payloads rendered from the tables: of each project the newest of a kind counts.
VIEWS["landed_events"] = f"""SELECT event_id AS landed, user_id % {PROJECTS} AS p, event_type AS e,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events"""
VIEWS["newest"] = """SELECT p, arg_max(k, landed) FILTER (e = 'click') AS c, arg_max(k, landed) FILTER (e = 'view') AS v,
  arg_max(k, landed) FILTER (e = 'signup') AS s, arg_max(k, landed) FILTER (e = 'purchase') AS r,
  arg_max(k, landed) FILTER (e = 'error') AS h FROM {landed_events} GROUP BY p"""
VIEWS["pages_of"] = f"""SELECT c_custkey % {PROJECTS} AS p, arg_max(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE c_nationkey + 1 END, c_custkey) AS commits
  FROM customer GROUP BY 1"""
VIEWS["lists_of"] = f"""SELECT s_suppkey % {PROJECTS} AS p,
  arg_max(s_nationkey, s_suppkey) FILTER (s_suppkey % 3 = 0) AS contributors,
  arg_max(s_nationkey, s_suppkey) FILTER (s_suppkey % 3 = 1) AS branches,
  arg_max(s_nationkey, s_suppkey) FILTER (s_suppkey % 3 = 2) AS tags FROM supplier GROUP BY 1"""
VIEWS["files_of"] = f"""SELECT p_partkey % {PROJECTS} AS p,
  sum(CASE WHEN p_size % 2 = 0 THEN 2 ELSE p_size END)::BIGINT AS deps,
  sum(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS dev,
  bool_or(p_size % 2 = 0) AS npm, bool_or(p_size % 2 = 1) AS pip FROM part GROUP BY 1"""
VIEWS["tree_of"] = f"""SELECT ord % {PROJECTS} AS p, count(*) FILTER (type = 'blob') AS total_files,
  count(*) FILTER (type = 'tree') AS total_dirs,
  max(length(path) - length(replace(path, '/', ''))) AS tree_depth,
  bool_or({" OR ".join(f"starts_with(path, {quote(c)})" for c in fixed.CI_PATHS)}) AS has_ci_cd,
  bool_or(contains(lower(path), 'dockerfile') OR contains(lower(path), 'docker-compose')) AS has_dockerfile,
  bool_or(lower(path) LIKE 'docs/%' OR lower(path) LIKE 'doc/%') AS has_docs,
  bool_or(contains(string_split(lower(path), '/')[1], 'test') OR lower(path) LIKE 'spec/%') AS has_tests,
  bool_or(lower(path) LIKE 'examples/%' OR lower(path) LIKE 'example/%') AS has_examples,
  bool_or(contains(lower(path), 'benchmark') OR contains(lower(path), 'bench/')) AS has_benchmarks,
  coalesce(arg_min(size, ord) FILTER (type = 'blob' AND lower(path) LIKE 'readme%'), 0) AS readme_size,
  count(*) FILTER (type = 'blob' AND {ext_sql(fixed.TREE_SOURCE_EXT)}
    AND NOT regexp_matches(lower(path), 'test|spec')) AS src_file_count,
  count(*) FILTER (type = 'blob' AND {ext_sql(fixed.TREE_SOURCE_EXT)}
    AND regexp_matches(lower(path), 'test|spec')) AS test_file_count,
  count(*) FILTER (type = 'blob' AND {ext_sql(fixed.TREE_CONFIG_EXT)}) AS config_file_count
  FROM {{tree}} GROUP BY 1"""
FLAGS = ["has_ci_cd", "has_dockerfile", "has_docs", "has_tests", "has_examples", "has_benchmarks"]
COUNTS = ["total_files", "total_dirs", "tree_depth", "readme_size", "src_file_count", "test_file_count", "config_file_count"]
DESCRIPTION = "CASE WHEN c % 2 = 0 THEN 'A fork of a novel compiler ' || c ELSE '' END"
TOPICS = "CASE WHEN c % 4 = 0 THEN '' ELSE 'wrapper,t' || c END"


def ratio(a: str, b: str, digits: int) -> str:
    return f"round(CAST(CAST({a} / greatest({b}, 1) AS VARCHAR) AS DECIMAL(38,12)), {digits})::DOUBLE"


def days(text: str) -> str:
    return f"CAST(floor((epoch(TIMESTAMP '2005-01-01') - epoch(strptime({text}, '%Y-%m-%dT%H:%M:%SZ'))) / 86400) AS BIGINT)"


CREATED, PUSHED = "'200' || (c % 4) || '-03-0' || (1 + c % 9) || 'T10:00:00Z'", "'2004-1' || (c % 3) || '-11T00:30:00Z'"
ROW_SQL = f"""
SELECT {URL_SQL} AS repo_url, 'Own' || (p % 7) AS owner, 'Proj-' || p AS repo_name,
  CASE WHEN c % 5 = 0 THEN 'Own' || (p % 7) || '/Proj-' || p ELSE 'full/' || c END AS full_name, {DESCRIPTION} AS description,
  '' AS homepage, CASE WHEN c % 6 = 0 THEN '' ELSE 'Rust' END AS language, c AS stars, CASE WHEN c % 10 = 3 THEN 0 ELSE c + 1 END AS watchers,
  c * 2 AS forks_count, 0 AS open_issues, 7 AS size_kb, 'trunk' AS default_branch, c % 2 = 1 AS is_fork, false AS is_archived,
  false AS is_template, true AS has_wiki, false AS has_pages, false AS has_discussions,
  CASE WHEN c % 3 = 0 THEN '' ELSE 'MIT' END AS license, {CREATED} AS created_at, '' AS updated_at, {PUSHED} AS pushed_at, {TOPICS} AS topics,
  0 AS network_count, CASE WHEN c % 8 = 0 THEN 'up/stream' ELSE '' END AS parent_repo, '' AS source_repo,
  coalesce(contributors, 0) AS contributor_count, coalesce(commits, 0) AS total_commits,
  coalesce(CASE WHEN v % 7 = 0 THEN 3 ELSE v * 2 + 6 END, 0)::BIGINT AS commits_last_year,
  coalesce(CASE WHEN v % 7 = 0 THEN 0 ELSE v END, 0)::BIGINT AS owner_commits_year,
  coalesce(CASE WHEN v % 7 = 0 THEN 0 ELSE (v + 6) / 4 END, 0)::DOUBLE AS recent_weekly_commit_avg,
  coalesce(CASE WHEN s % 11 = 0 THEN 0 ELSE 2 END, 0) AS languages_count,
  coalesce(CASE WHEN s % 11 = 0 THEN 0 ELSE round(greatest(s, 100) / (s + 100) * 100, 1) END, 0)::DOUBLE AS primary_language_pct,
  bytes AS total_code_bytes, CASE WHEN s % 11 > 0 THEN '{{"Go":' || s || ',"Rust":100}}' ELSE '' END AS languages_detail,
  coalesce(r % 5, 0) AS release_count, CASE WHEN r % 5 > 0 THEN '2004-r' || r ELSE '' END AS latest_release_date,
  coalesce(r % 5 > 0, false) AS has_releases, coalesce(branches, 0) AS branch_count, coalesce(tags, 0) AS tag_count,
  deps AS dependency_count, coalesce(dev, 0) AS dev_dependency_count,
  concat_ws(',', CASE WHEN npm THEN 'package.json' END, CASE WHEN pip THEN 'requirements.txt' END) AS dep_files_found,
  concat_ws(',', CASE WHEN npm THEN 'npm' END, CASE WHEN pip THEN 'pip' END) AS dep_ecosystems,
  coalesce(npm::INT, 0) + coalesce(pip::INT, 0) AS dep_ecosystem_count,
  {", ".join(f"coalesce({n}, 0) AS {n}" for n in COUNTS)}, {", ".join(f"coalesce({n}, false) AS {n}" for n in FLAGS)},
  {hits_sql(f"lower({DESCRIPTION} || ' ' || {TOPICS})", fixed.WRAPPER_PHRASES)} AS desc_fork_wrapper_signals,
  {hits_sql(f"lower({DESCRIPTION} || ' ' || {TOPICS})", fixed.ORIGINAL_PHRASES)} AS desc_originality_signals,
  length({DESCRIPTION}) AS desc_length, CASE WHEN h % 13 = 0 THEN 0 ELSE coalesce(h, 0) END AS health_percentage,
  false AS has_code_of_conduct, coalesce(h % 13 > 0, false) AS has_contributing, coalesce(h % 13 > 0 AND h % 2 = 0, false) AS has_issue_template,
  false AS has_pull_request_template, {days(CREATED)} AS age_days, {days(PUSHED)} AS days_since_push,
  {ratio("c * 2", "c", 4)} AS fork_to_star_ratio, {ratio("deps", "coalesce(src_file_count, 0)", 4)} AS deps_per_src_file,
  {ratio("deps", "bytes / 1000", 6)} AS deps_per_1k_loc,
  {ratio("coalesce(src_file_count, 0)", "coalesce(total_files, 0)", 4)} AS src_to_total_file_ratio,
  {ratio("coalesce(commits, 0)", "coalesce(contributors, 0)", 2)} AS commits_per_contributor,
  {ratio("c", "coalesce(contributors, 0)", 2)} AS stars_per_contributor, {ratio("bytes", "deps", 2)} AS code_bytes_per_dep,
  {ratio("coalesce(commits, 0)", f"{days(CREATED)}", 4)} AS commits_per_age_day
FROM (SELECT n.*, commits, contributors, branches, tags, coalesce(deps, 0) AS deps, dev, npm, pip, t.* EXCLUDE (p),
    coalesce(CASE WHEN s % 11 = 0 THEN 0 ELSE s + 100 END, 0) AS bytes
  FROM newest n LEFT JOIN pages_of USING (p) LEFT JOIN lists_of USING (p) LEFT JOIN files_of USING (p) LEFT JOIN tree_of t USING (p)
  WHERE c IS NOT NULL)"""


def landed(t: Tables) -> DataFrame:
    """Payloads of every kind, rendered from the tables; some hold what does not fit."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")

    def text(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def yes(condition):
        return F.when(condition, "true").otherwise("false")

    repo = text(
        "{", F.when(k % 5 > 0, text('"full_name":"full/', k, '",')).otherwise(""),
        F.when(k % 2 == 0, text('"description":"A fork of a novel compiler ', k, '",')).otherwise('"description":null,'),
        F.when(k % 6 == 0, "").otherwise('"language":"Rust",'), '"stargazers_count":', k, ',"subscribers_count":',
        F.when(k % 10 == 3, '"many"').otherwise((k + 1).cast("string")), ',"forks_count":"', k * 2, '","size":7,"default_branch":"trunk","fork":',
        yes(k % 2 == 1), ',"has_wiki":true,"license":', F.when(k % 3 == 0, "null").otherwise('{"spdx_id":"MIT"}'),
        ',"created_at":"200', k % 4, "-03-0", k % 9 + 1, 'T10:00:00Z","pushed_at":"2004-1', k % 3, '-11T00:30:00Z","topics":[',
        F.when(k % 4 == 0, "").otherwise(text('"wrapper","t', k, '"')), "]", F.when(k % 8 == 0, ',"parent":{"full_name":"up/stream"}').otherwise(""), "}")
    year = F.when(k % 7 == 0, '{"all":[1,2]}').otherwise(text('{"all":[', k, ",1,2,3,", k, '],"owner":[', k, "]}"))
    sizes = F.when(k % 11 == 0, "{}").otherwise(text('{"Rust":100,"Go":', k, "}"))
    release = F.array_repeat(F.when(k % 5 > 0, text('{"published_at":"2004-r', k, '"}')), (k % 5).cast("int"))
    health = F.when(k % 13 == 0, '{"health_percentage":').otherwise(text(
        '{"health_percentage":', k, ',"files":{"contributing":{"url":"u"},"code_of_conduct":null', F.when(k % 2 == 0, ',"issue_template":{}').otherwise(""), "}}"))
    kind = F.col("event_type")
    events = t.events.select(
        (F.col("user_id") % PROJECTS).alias("p"), F.col("event_id").alias("landed"),
        F.when(kind == "click", "repo").when(kind == "view", "participation").when(kind == "signup", "languages")
        .when(kind == "purchase", "releases").otherwise("community").alias("kind"),
        F.when(kind == "click", repo).when(kind == "view", year).when(kind == "signup", sizes)
        .when(kind == "purchase", text("[", F.array_join(release, ","), "]")).otherwise(health).alias("payload"),
        F.lit(None).cast("string").alias("header"))
    more = F.col("c_custkey") % 3 > 0
    commits = t.customer.select(
        (F.col("c_custkey") % PROJECTS).alias("p"), F.col("c_custkey").alias("landed"), F.lit("commits").alias("kind"),
        F.lit('[{"sha":"a"},{"sha":"b"}]').alias("payload"),
        F.when(more, text("<u?page=", F.col("c_nationkey") + 1, '>; rel="last"')).alias("header"))
    which = F.col("s_suppkey") % 3
    lists = t.supplier.select(
        (F.col("s_suppkey") % PROJECTS).alias("p"), F.col("s_suppkey").alias("landed"),
        F.when(which == 0, "contributors").when(which == 1, "branches").otherwise("tags").alias("kind"),
        text("[", F.array_join(F.array_repeat(F.lit('{"n":1}'), F.col("s_nationkey").cast("int")), ","), "]").alias("payload"),
        F.lit(None).cast("string").alias("header"))
    entry = F.struct("ord", F.to_json(F.struct("path", "type", "size")).alias("j"))
    trees = t.tree.groupBy((F.col("ord") % PROJECTS).alias("p")).agg(F.array_sort(F.collect_list(entry))["j"].alias("j")).select(
        "p", F.lit(1).cast("bigint").alias("landed"), F.lit("tree").alias("kind"),
        text('{"tree":[', F.array_join("j", ","), "]}").alias("payload"), F.lit(None).cast("string").alias("header"))
    url = F.concat(F.lit("https://github.com/Own"), (F.col("p") % 7).cast("string"), F.lit("/Proj-"), F.col("p").cast("string"))
    return events.unionByName(commits).unionByName(lists).unionByName(trees).select(
        url.alias("repo_url"), "kind", "payload", "header", "landed")


def manifest_payloads(t: Tables) -> DataFrame:
    p = F.col("p_partkey") % PROJECTS
    npm = F.col("p_size") % 2 == 0
    lines = F.array_join(F.array_repeat(F.lit("dep"), F.col("p_size").cast("int")), "\n")
    content = F.when(npm, '{"dependencies":{"a":"1","b":"2"},"devDependencies":{"c":"3"}}').otherwise(lines)
    return t.part.select(
        F.concat(F.lit("https://github.com/Own"), (p % 7).cast("string"), F.lit("/Proj-"), p.cast("string")).alias("repo_url"),
        F.when(npm, "package.json").otherwise("requirements.txt").alias("name"),
        F.base64(content.cast("binary")).alias("payload"))


@query("project_rows", with_views("newest pages_of lists_of files_of tree_of", ROW_SQL))
def project_rows(t: Tables) -> DataFrame:
    """All 77 columns of every project."""
    return project_row.collected(landed(t), AS_OF, manifest_payloads(t))[0]


@query("payload_audit", with_views("landed_events", f"""SELECT {URL_SQL} AS repo_url, 'repo' AS kind, landed,
  '$.subscribers_count' AS path, '"many"' AS found FROM landed_events WHERE e = 'click' AND k % 10 = 3
  UNION ALL SELECT {URL_SQL}, 'community', landed, '$', '' FROM landed_events
  WHERE e NOT IN ('click', 'view', 'signup', 'purchase') AND k % 13 = 0"""))
def payload_audit(t: Tables) -> DataFrame:
    return project_row.payload_audit(cut_lineage(project_row.typed_payloads(landed(t))))


# A dictionary too large for a plan: every word of the benchmark of four letters or more, and
# every part name, most of which have two words.
VIEWS["dictionary"] = """SELECT DISTINCT w FROM (
  SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark UNION ALL SELECT p_name FROM part
  UNION ALL SELECT lang || 'e ' || lang FROM documents UNION ALL SELECT unnest(['the of', 'of the the', 'is', 'e', '.', 'it is and'])) WHERE length(w) > 0"""


@query("large_dictionary", with_views("dictionary", """SELECT doc_id, count(*) AS n, min(w) AS first, max(w) AS last,
  md5(string_agg(w, ',' ORDER BY w)) AS phrases FROM documents JOIN dictionary ON contains(lower(text), lower(w)) GROUP BY doc_id"""))
def large_dictionary(t: Tables) -> DataFrame:
    """Per document the phrases it contains, of thousands."""
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    pairs = t.documents.select(F.concat("lang", F.lit("e "), "lang").alias("w"))
    few = t.spark.createDataFrame([(x,) for x in ("the of", "of the the", "is", "e", ".", "it is and")], "w string")
    dictionary = words.union(t.part.select("p_name")).union(pairs).union(few).distinct()
    found = containment.contains_any(t.documents, "doc_id", "text", dictionary, "w")
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("w").alias("first"), F.max("w").alias("last"),
        F.md5(F.array_join(F.array_sort(F.collect_list("w")), ",").cast("binary")).alias("phrases"))
