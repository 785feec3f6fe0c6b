"""Sources, keys, joins, sets, sorts and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, payloads
from ..functions.text import decode_base64
from ..operators import aggregates, features, joins, ranking
from ..session import cut_lineage, fresh_path
from ..sources import readers, writers
from ..streaming import resume
from .registry import query
from .views import AS_OF, HIGH, LOW, Tables, quote, sql_list, with_views

CUSTOMER = ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
            "c_mktsegment string")


# ---- sources and sinks -------------------------------------------------------------------

@query("csv_round_trip", "SELECT * FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    writers.write_csv(t.customer, path)
    return readers.read_csv(t.spark, path, CUSTOMER, multi_line=False)


@query("json_round_trip", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def json_round_trip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "json")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    writers.write_json(rows, path, ["o_orderstatus"])
    return t.spark.read.schema(
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string").json(path)


@query("adjacency_explode", """SELECT 'https://github.com/acme/p' || l_orderkey AS src,
  'https://github.com/acme/' || d AS dst FROM (SELECT l_orderkey,
    unnest(['part-' || l_partkey, 'supp-' || l_suppkey]) AS d FROM lineitem)""")
def adjacency_explode(t: Tables) -> DataFrame:
    def url(prefix, column):
        return F.concat(F.lit('"https://github.com/acme/' + prefix), F.col(column), F.lit('"'))

    lines = t.lineitem.select(F.concat(
        F.lit("{"), url("p", "l_orderkey"), F.lit(": ["), url("part-", "l_partkey"), F.lit(", "),
        url("supp-", "l_suppkey"), F.lit("]}")).alias("value"))
    return readers.edges_of(readers.adjacency(lines))


@query("giant_adjacency", """SELECT 'https://github.com/acme/p' || l_orderkey AS src,
  'https://github.com/acme/' || d AS dst FROM (SELECT l_orderkey, unnest(['part-' || l_partkey, 'supp-' || l_suppkey]) AS d
    FROM lineitem)""")
def giant_adjacency(t: Tables) -> DataFrame:
    """JSON objects over all orders, one entry after another without line ends."""
    def url(prefix, column):
        return F.concat(F.lit('"https://github.com/acme/' + prefix), F.col(column), F.lit('"'))

    path = fresh_path(t.spark, "giant")
    entries = t.lineitem.select(F.concat(
        F.lit(", "), url("p", "l_orderkey"), F.lit(": ["), url("part-", "l_partkey"), F.lit(", "),
        url("supp-", "l_suppkey"), F.lit("]")).alias("value"))
    entries.write.option("lineSep", " ").text(path)
    return readers.read_giant_edges(t.spark, path)


@query("source_files", with_views("file_kinds", r"""SELECT repo, path, length(content) AS n
  FROM file_kinds WHERE language IS NOT NULL AND regexp_matches(content, '\S')"""))
def source_files(t: Tables) -> DataFrame:
    return readers.only_source(t.files).select("repo", "path", F.length("content").alias("n"))


@query("optional_source_defaults", """SELECT c_custkey AS id, 0.0::DOUBLE AS producer_score,
  0.0::DOUBLE AS consumer_score, 0.5::DOUBLE AS pc_ratio, 0.0::DOUBLE AS ai_scratch,
  3.0::DOUBLE AS repo_age_years FROM customer""")
def optional_source_defaults(t: Tables) -> DataFrame:
    absent = readers.optional(
        lambda: readers.read_csv(t.spark, f"{t.folder}/absent_signals.csv", readers.SIGNAL_SCHEMA),
        t.spark, readers.SIGNAL_SCHEMA)
    base = features.with_age(t.customer.select(F.col("c_custkey").alias("id"),
                                               F.col("c_name").alias("repo_url")), AS_OF)
    base = features.with_signals(base, absent, "repo_url")
    base = features.with_defaults(base, features.GRAPH_DEFAULTS)
    return base.select("id", *features.GRAPH_DEFAULTS, "ai_scratch", "repo_age_years")


@query("base64_decode", "SELECT doc_id, text FROM documents")
def base64_decode(t: Tables) -> DataFrame:
    landed = t.documents.select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("payload"))
    return landed.select("doc_id", decode_base64(F.col("payload")).alias("text"))


@query("json_flatten", r"""SELECT event_id, user_id || '/' || event_type AS full_name,
  '' AS description, '' AS homepage, '' AS language,
  CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS stars, 0::BIGINT AS watchers,
  user_id AS forks_count, 0::BIGINT AS open_issues, 0::BIGINT AS size_kb, 'main' AS default_branch,
  event_type = 'view' AS is_fork, false AS is_archived, false AS is_template, false AS has_wiki,
  false AS has_pages, false AS has_discussions,
  CASE WHEN event_type = 'click' THEN 'MIT' ELSE '' END AS license, '' AS created_at,
  '' AS updated_at, '' AS pushed_at, event_type || ',t' || user_id AS topics,
  0::BIGINT AS network_count,
  CASE WHEN event_type = 'view' THEN 'up/' || user_id ELSE '' END AS parent_repo,
  '' AS source_repo FROM events""")
def json_flatten(t: Tables) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    landed = t.events.select("event_id", F.to_json(F.struct(
        F.concat(user, F.lit("/"), kind).alias("full_name"), k.alias("stargazers_count"),
        user.alias("forks_count"), (kind == "view").alias("fork"),
        F.when(kind == "click", F.struct(F.lit("MIT").alias("spdx_id"))).alias("license"),
        F.array(kind, F.concat(F.lit("t"), user)).alias("topics"),
        F.when(kind == "view", F.struct(F.concat(F.lit("up/"), user).alias("full_name")))
        .alias("parent"))).alias("raw"))
    parsed = landed.select("event_id",
                           F.from_json("raw", payloads.METADATA_SCHEMA).alias("payload"))
    return parsed.select("event_id", *payloads.metadata_columns())


# ---- keys --------------------------------------------------------------------------------

@query("url_slug", "SELECT page_id, replace(rtrim(lower(url), '/'), 'https://', '') AS slug FROM pages")
def url_slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", keys.slug(F.col("url"), "https://").alias("slug"))


@query("url_slug_cased", "SELECT page_id, string_split(rtrim(url, '/'), '.com/')[-1] AS slug FROM pages")
def url_slug_cased(t: Tables) -> DataFrame:
    return t.pages.select("page_id", keys.slug_keep_case(F.col("url"), ".com/").alias("slug"))


@query("url_canonical", """SELECT page_id, CASE WHEN starts_with(rtrim(url, '/'), 'https://')
  THEN rtrim(url, '/') ELSE 'https://github.com/' || rtrim(url, '/') END AS url FROM pages""")
def url_canonical(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(" \t"), F.col("url"), F.lit("/\n"))
    return t.pages.select("page_id", keys.canonical(padded).alias("url"))


@query("url_parts", r"""SELECT page_id,
  nullif(regexp_extract(rtrim(url, '/'), '^https?://([^/]+)/([^/]+)', 1), '') AS owner,
  nullif(regexp_extract(rtrim(url, '/'), '^https?://([^/]+)/([^/]+)', 2), '') AS name FROM pages""")
def url_parts(t: Tables) -> DataFrame:
    owner, name = keys.owner_and_name(F.col("url"), r"^https?://([^/]+)/([^/]+)")
    return t.pages.select("page_id", owner.alias("owner"), name.alias("name"))


@query("url_leaf", "SELECT page_id, string_split(url, '/')[-1] AS leaf FROM pages")
def url_leaf(t: Tables) -> DataFrame:
    return t.pages.select("page_id", keys.leaf(F.col("url")).alias("leaf"))


# ---- joins -------------------------------------------------------------------------------

@query("feature_assembly", """SELECT c_custkey AS repo_url, c_mktsegment, n, low, tag
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_totalprice) AS low FROM orders
    GROUP BY o_custkey) ON o_custkey = c_custkey
  LEFT JOIN (SELECT doc_id, source AS tag FROM documents) ON doc_id = c_custkey""")
def feature_assembly(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("repo_url"), "c_mktsegment")
    placed = t.orders.groupBy(F.col("o_custkey").alias("repo_url")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"))
    docs = t.documents.select(F.col("doc_id").alias("repo_url"), F.col("source").alias("tag"))
    return joins.assemble(base, [(placed, ["n", "low"]), (docs, ["tag"])], "repo_url")


ASSEMBLED_SQL = """SELECT c_custkey AS repo_url, c_mktsegment, n, low, tag
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_totalprice) AS low FROM orders
    GROUP BY o_custkey) ON o_custkey = c_custkey
  LEFT JOIN (SELECT doc_id, source AS tag FROM documents) ON doc_id = c_custkey"""


@query("bucketed_assembly", ASSEMBLED_SQL)
def bucketed_assembly(t: Tables) -> DataFrame:
    """The same from tables that are bucketed alike: no exchange is left."""
    def bucketed(df, name):
        path = fresh_path(t.spark, name)
        return writers.write_bucketed(df, path.rsplit("/", 1)[-1].replace("-", "_"), "repo_url", 8, path)

    base = bucketed(t.customer.select(F.col("c_custkey").alias("repo_url"), "c_mktsegment"), "base")
    placed = bucketed(t.orders.groupBy(F.col("o_custkey").alias("repo_url")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low")), "placed")
    docs = bucketed(t.documents.select(F.col("doc_id").alias("repo_url"), F.col("source").alias("tag")), "docs")
    return joins.assemble(base, [(placed, ["n", "low"]), (docs, ["tag"])], "repo_url")


@query("anchor_join", with_views("projects anchors", """SELECT p.id, a.target,
  p.repo_url = a.url AS exact FROM projects p JOIN (
    SELECT target, 'https://github.com/' || c_mktsegment || '/' || CASE WHEN id % 7 = 0
      THEN lower(replace(c_name, '#', '-')) ELSE replace(c_name, '#', '-') END AS url
    FROM anchors JOIN customer ON c_custkey = id) a ON lower(a.url) = lower(p.repo_url)"""))
def anchor_join(t: Tables) -> DataFrame:
    name = F.replace("c_name", F.lit("#"), F.lit("-"))
    jury = t.anchors.join(t.customer, F.col("id") == F.col("c_custkey")).select(
        "target", F.concat("c_mktsegment", F.lit("/"), F.when(F.col("id") % 7 == 0, F.lower(name))
                           .otherwise(name)).alias("repo"))
    projects = t.projects.select("id", "repo_url")
    loose = joins.anchor_join(jury, projects, case_insensitive=True)
    strict = joins.anchor_join(jury, projects).select("id", F.lit(True).alias("exact"))
    return loose.join(strict, "id", "left").select(
        "id", "target", F.coalesce("exact", F.lit(False)).alias("exact"))


@query("remaining_keys", """SELECT c_custkey FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def remaining_keys(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.remaining(t.customer.select("c_custkey"), done, "c_custkey")


@query("induced_edges", with_views("known_edges", "SELECT src, dst FROM known_edges"))
def induced_edges(t: Tables) -> DataFrame:
    return joins.induced(t.edges, t.nodes)


@query("lookup_default", """SELECT c_custkey, coalesce(v, 'none') AS o_orderpriority
  FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders
    GROUP BY o_custkey) ON o_custkey = c_custkey""")
def lookup_default(t: Tables) -> DataFrame:
    table = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    return joins.lookup_default(t.customer.select("c_custkey"), table, "c_custkey",
                                "o_orderpriority", "none", ["o_orderkey"])


@query("tiered_lookup", """SELECT c_custkey, CASE WHEN d.doc_id IS NOT NULL THEN lang
  ELSE coalesce(c_mktsegment, '') END AS label
  FROM customer LEFT JOIN documents d ON d.doc_id = c_custkey""")
def tiered_lookup(t: Tables) -> DataFrame:
    first = t.documents.select(F.col("doc_id").alias("c_custkey"), F.col("lang").alias("label"))
    second = t.customer.select("c_custkey", F.col("c_mktsegment").alias("label"))
    return joins.tiered_lookup(t.customer.select("c_custkey"), first, second, "c_custkey",
                               "label", "")


@query("keyword_contains_join", f"""SELECT keyword, count(*) AS n FROM (
  SELECT unnest(list_filter({sql_list(HIGH + LOW)}, lambda k: contains(lower(text), k))) AS keyword
  FROM documents) GROUP BY keyword""")
def keyword_contains_join(t: Tables) -> DataFrame:
    found = joins.contains_join(t.documents, "text", HIGH + LOW)
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


# ---- aggregations and reports ------------------------------------------------------------

@query("usage_rollup", with_views("usage", """SELECT repo, count(dependency) AS n_deps,
  count(*) FILTER (source_match) AS n_source, round(sum(weighted_score), 4) AS total_weight
  FROM usage GROUP BY repo"""))
def usage_rollup(t: Tables) -> DataFrame:
    return aggregates.usage_rollup(t.usage).withColumn("total_weight", F.round("total_weight", 4))


@query("global_norm", """SELECT o_orderkey, round(ln(1 + o_totalprice)
  / ln(1 + (SELECT max(o_totalprice) FROM orders)), 6) AS plain, round(ln(1 + o_totalprice)
  / ln(1 + (SELECT max(nullif(o_totalprice, 0)) FROM orders)), 6) AS nonzero,
  round(ln(1 + o_totalprice) / ln(1 + greatest((SELECT max(o_totalprice) FROM orders), 1e6)), 6)
  AS floored FROM orders""")
def global_norm(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        "o_orderkey",
        F.round(aggregates.global_log_norm(o, "o_totalprice"), 6).alias("plain"),
        F.round(aggregates.global_log_norm(o, "o_totalprice", positive_only=True), 6)
        .alias("nonzero"),
        F.round(aggregates.global_log_norm(o, "o_totalprice", floor=1e6), 6).alias("floored"))


@query("score_summary", """SELECT round(avg(o_totalprice), 2) AS mean,
  round(median(o_totalprice), 4) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max
  FROM orders""")
def score_summary(t: Tables) -> DataFrame:
    return aggregates.summary(t.orders, "o_totalprice").withColumns(
        {"mean": F.round("mean", 2), "median": F.round("median", 4)})


@query("category_counts", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def category_counts(t: Tables) -> DataFrame:
    return aggregates.frequencies(t.customer, "c_mktsegment")


PROFILED = ["stars", "commits_last_year", "graph_dep_count", "cargo_lock_total_packages",
            "go_sum_unique_modules", "depsdev_transitive_deps", "depsdev_direct_deps",
            "dependency_count", "total_code_bytes", "contributor_count"]


@query("quality_profile", with_views("projects", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {quote(c)} AS \"column\", count(*) FILTER ({c} = 0) AS zeros, "
    f"count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS total FROM projects"
    for c in ["id"] + PROFILED) + ") WHERE zeros > 0 OR nulls > 0"))
def quality_profile(t: Tables) -> DataFrame:
    return aggregates.quality_profile(t.projects.select("id", *PROFILED))


@query("hit_rates", with_views("usage", """SELECT count(DISTINCT repo) AS repos_done,
  count(*) FILTER (manifest_match) AS manifest_hits,
  round(count(*) FILTER (manifest_match) * 100 / greatest(count(*), 1), 1) AS manifest_pct,
  count(*) FILTER (source_match) AS source_hits,
  round(count(*) FILTER (source_match) * 100 / greatest(count(*), 1), 1) AS source_pct,
  count(*) FILTER (weighted_score > 0) AS any_usage,
  round(count(*) FILTER (weighted_score > 0) * 100 / greatest(count(*), 1), 1) AS any_pct,
  CAST(sum(total_calls) AS BIGINT) AS total_calls FROM usage WHERE file_count >= 0"""))
def hit_rates(t: Tables) -> DataFrame:
    return aggregates.hit_rates(t.usage)


@query("top_dependencies", with_views("usage", """SELECT dependency,
  round(sum(weighted_score), 4) AS weight FROM usage WHERE file_count >= 0 GROUP BY dependency
  ORDER BY round(sum(weighted_score), 6) DESC, dependency LIMIT 15"""))
def top_dependencies(t: Tables) -> DataFrame:
    return aggregates.top_dependencies(t.usage).withColumn("weight", F.round("weight", 4))


@query("score_histogram", """SELECT CAST(floor(o_totalprice / 25000) AS BIGINT) AS bucket,
  count(*) AS n FROM orders GROUP BY 1""")
def score_histogram(t: Tables) -> DataFrame:
    return aggregates.histogram(t.orders, "o_totalprice", 25000.0)


@query("category_spread", """SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS low,
  round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(quantile_cont(c_acctbal, 0.5), 4) AS q2,
  round(quantile_cont(c_acctbal, 0.75), 4) AS q3, max(c_acctbal) AS high,
  round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment""")
def category_spread(t: Tables) -> DataFrame:
    return aggregates.spread(t.customer, "c_mktsegment", "c_acctbal").withColumns(
        {c: F.round(c, 4) for c in ("q1", "q2", "q3", "mean")})


@query("quadrant_counts", """SELECT CASE WHEN n >= 12 THEN 'high' ELSE 'low' END AS producer_side,
  CASE WHEN v >= 250000 THEN 'high' ELSE 'low' END AS consumer_side, count(*) AS n
  FROM (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS v FROM orders GROUP BY o_custkey)
  GROUP BY 1, 2""")
def quadrant_counts(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("p"),
                                            F.avg("o_totalprice").alias("c"))
    return aggregates.quadrants(per, "p", "c", 12, 250000)


@query("package_rollup", """SELECT o_custkey AS repo_url, bool_or(found) AS depsdev_found,
  coalesce(arg_max(o_orderstatus || o_orderkey, o_orderkey) FILTER (found), '') AS depsdev_version,
  CAST(coalesce(sum(d) FILTER (found), 0) AS BIGINT) AS depsdev_direct_deps,
  CAST(coalesce(sum(tr) FILTER (found), 0) AS BIGINT) AS depsdev_transitive_deps,
  coalesce(string_agg(substr(o_orderpriority, 3), ',' ORDER BY o_orderkey) FILTER (found), '')
    AS depsdev_ecosystem,
  coalesce(string_agg('pkg' || o_orderkey, ',' ORDER BY o_orderkey) FILTER (found), '')
    AS depsdev_package
  FROM (SELECT *, o_orderstatus <> 'P' AS found, o_orderkey % 10 AS d, o_orderkey % 97 AS tr
    FROM orders) GROUP BY o_custkey""")
def package_rollup(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    packages = t.orders.select(
        F.col("o_custkey").alias("repo_url"), key.alias("ord"),
        F.substring("o_orderpriority", 3, 100).alias("ecosystem"),
        F.concat(F.lit("pkg"), key).alias("package"),
        F.concat("o_orderstatus", key).alias("version"), (key % 10).alias("direct"),
        (key % 97).alias("transitive"), (F.col("o_orderstatus") != "P").alias("found"))
    return aggregates.package_rollup(packages)


# ---- sorts, limits, picks ----------------------------------------------------------------

@query("ranked_scores", "SELECT o_orderkey, o_totalprice FROM orders")
def ranked_scores(t: Tables) -> DataFrame:
    return ranking.ranked(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice",
                          "o_orderkey")


@query("top_bottom", """SELECT * FROM (SELECT o_orderkey, o_totalprice, 'top' AS side FROM orders
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 15) UNION ALL SELECT * FROM (SELECT o_orderkey,
  o_totalprice, 'bottom' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15)""")
def top_bottom(t: Tables) -> DataFrame:
    return ranking.best_and_worst(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice",
                                  "o_orderkey")


@query("first_success", """SELECT o_orderkey, n, branch FROM (SELECT DISTINCT l_orderkey AS o_orderkey
  FROM lineitem) LEFT JOIN (SELECT l_orderkey, CAST(l_quantity AS INT) % 4 AS n,
    'b' || l_linenumber || '-' || l_partkey AS branch, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey) AS r
    FROM lineitem WHERE CAST(l_quantity AS INT) % 4 > 0) ON l_orderkey = o_orderkey AND r = 1""")
def first_success(t: Tables) -> DataFrame:
    packages = F.col("l_quantity").cast("int") % 4
    tries = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("prio"),
        F.concat(F.lit("b"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey")).alias("branch"),
        F.repeat(F.lit("[[package]]\n"), packages).alias("content"))
    tries = tries.withColumn("n", F.regexp_count("content", F.lit(r"\[\[package\]\]")))
    return ranking.first_success(tries, "o_orderkey", "prio",
                                 F.contains("content", F.lit("[[package]]")), ["n", "branch"])


@query("default_or_last", """SELECT l_partkey, coalesce(
  arg_min(v, pos) FILTER (l_discount = 0.1), arg_max(v, pos)) AS version FROM (SELECT *,
    l_orderkey || '.' || l_linenumber || '.' || l_suppkey AS v,
    (l_orderkey * 100 + l_linenumber) * 1000000 + l_suppkey AS pos FROM lineitem) GROUP BY l_partkey""")
def default_or_last(t: Tables) -> DataFrame:
    versions = t.lineitem.select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey",
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_suppkey").alias("version"),
        (F.col("l_discount") == 0.1).alias("is_default"))
    return ranking.default_or_last(versions, "l_partkey", "version", "is_default",
                                   ["l_orderkey", "l_linenumber", "l_suppkey"])


# ---- sets --------------------------------------------------------------------------------

@query("append_results", """SELECT o_orderkey, o_totalprice, NULL AS o_custkey FROM orders
  WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice, o_custkey FROM orders""")
def append_results(t: Tables) -> DataFrame:
    old = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return joins.append_results(old, t.orders.select("o_totalprice", "o_custkey", "o_orderkey"))


@query("distinct_dependencies", """SELECT DISTINCT unnest(['part-' || l_partkey, 'supp-' || l_suppkey])
  AS dependency FROM lineitem""")
def distinct_dependencies(t: Tables) -> DataFrame:
    listed = t.lineitem.select(F.array(F.concat(F.lit("part-"), F.col("l_partkey")),
                                       F.concat(F.lit("supp-"), F.col("l_suppkey")))
                               .alias("targets"))
    return joins.distinct_targets(listed, "targets")


@query("done_minus_failed", with_views("usage", """SELECT DISTINCT repo FROM usage
  EXCEPT SELECT repo FROM usage WHERE file_count = -1"""))
def done_minus_failed(t: Tables) -> DataFrame:
    return joins.done_minus_failed(t.usage, "repo")


@query("success_filter", with_views("usage", """SELECT repo, dependency, total_calls FROM usage
  WHERE file_count >= 0"""))
def success_filter(t: Tables) -> DataFrame:
    return t.usage.filter(F.col("file_count") >= 0).select("repo", "dependency", "total_calls")


@query("terms_overlap", """SELECT p_partkey, replace(p_name, ' ', '_') = lower(replace(p_type || '_x', '.', '_'))
  OR length(p_brand) = 8 AS overlap FROM part""")
def terms_overlap(t: Tables) -> DataFrame:
    terms = F.array(F.replace("p_name", F.lit(" "), F.lit("-")), F.lower("p_brand"))
    names = F.array(F.concat("p_type", F.lit(".x")),
                    F.when(F.length("p_brand") == 8, F.col("p_brand")).otherwise(F.lit("none")))
    return t.part.select("p_partkey", joins.terms_overlap(terms, names).alias("overlap"))


# ---- incremental -------------------------------------------------------------------------

@query("resume_batch", with_views("usage", """SELECT repo, dependency, file_count FROM usage
  WHERE file_count <> -1 UNION ALL SELECT c_custkey, NULL, 7 FROM customer WHERE c_custkey NOT IN
  (SELECT repo FROM usage EXCEPT SELECT repo FROM usage WHERE file_count = -1)"""))
def resume_batch(t: Tables) -> DataFrame:
    expected = t.customer.select(F.col("c_custkey").alias("repo"))
    existing = t.usage.select("repo", "dependency", "file_count")
    return resume.resume(expected, existing,
                         lambda todo: todo.select("repo", F.lit(7).cast("bigint").alias("file_count")))


@query("coverage_audit", with_views("usage", """SELECT c_custkey AS repo, coalesce(n, 0) AS total_calls,
  coalesce(f, -1) AS file_count FROM customer LEFT JOIN (SELECT repo, max(total_calls) AS n,
  max(file_count) AS f FROM usage WHERE file_count > 40 GROUP BY repo) u ON u.repo = c_custkey"""))
def coverage_audit(t: Tables) -> DataFrame:
    done = t.usage.filter("file_count > 40").groupBy("repo").agg(
        F.max("total_calls").alias("total_calls"), F.max("file_count").alias("file_count"))
    return resume.coverage_audit(t.customer.select(F.col("c_custkey").alias("repo")), done, ["repo"])


@query("stream_upsert", """SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 1
  UNION ALL SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 0
    AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1)""")
def stream_upsert(t: Tables) -> DataFrame:
    """Events land in two batches; the second replaces all rows of the users it has."""
    source, out = fresh_path(t.spark, "landing"), fresh_path(t.spark, "upsert")
    rows = t.events.select("user_id", "event_id", "value")
    for batch in (0, 1):
        rows.filter(F.col("event_id") % 2 == batch).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(rows.schema).parquet(source)
        resume.upsert_batches(stream, lambda df: df, out + "/rows", out + "/state", "user_id", buckets=16)
    return t.spark.read.parquet(out + "/rows").drop("_bucket")


@query("sketched_quantiles", """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, true AS within
  FROM lineitem GROUP BY l_returnflag""")
def sketched_quantiles(t: Tables) -> DataFrame:
    """Quantiles from sketches of seven batches, held against the exact ranks of their values."""
    parts = aggregates.sketches(t.lineitem.withColumn("batch", F.col("l_orderkey") % 7), "l_extendedprice", ["l_returnflag", "batch"])
    merged = cut_lineage(aggregates.merged_sketches(cut_lineage(parts), ["l_returnflag"]))
    shares = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    found = merged.select("l_returnflag", *[c.alias(n) for n, c in aggregates.sketched_quantiles(merged, shares).items()])
    met = t.lineitem.join(F.broadcast(found), "l_returnflag")  # a row a flag
    ranks = met.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("mean").alias("mean"),
        *[F.avg((F.col("l_extendedprice") <= F.col(n)).cast("int")).alias(f"r_{n}") for n in shares])
    near = [F.abs(F.col(f"r_{n}") - q) <= aggregates.RANK_ERROR + 1 / F.col("n") for n, q in shares.items()]
    return ranks.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), (near[0] & near[1] & near[2]).alias("within"))


@query("stream_resume", """SELECT user_id, count(*) AS n, CAST(round(sum(value * 100)) AS BIGINT) AS cents
  FROM events GROUP BY user_id""")
def stream_resume(t: Tables) -> DataFrame:
    stream = (t.spark.readStream.schema(t.events.schema)
              .option("pathGlobFilter", "events.parquet").parquet(t.folder))
    out = fresh_path(t.spark, "stream")
    resume.run_batches(
        stream, lambda batch: batch.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")),
        out + "/batches", out + "/state")
    return resume.merged(t.spark, out + "/batches", ["user_id"], ["n", "cents"])
