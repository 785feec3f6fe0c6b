"""Text, path and payload queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths, payloads, text
from ..operators.tree import tree_stats as tree_statistics
from .registry import query
from .scoring_plan import hits_sql, rule_sql
from .views import HIGH, LOW, NAMED, RULES, Tables, quote, sql_case, sql_list, with_views

LOWERED = "lower(text)"


@query("keyword_hits", f"""SELECT doc_id, {hits_sql(LOWERED, HIGH)} AS high,
  {hits_sql(LOWERED, LOW)} AS low FROM documents""")
def keyword_hits(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.keyword_hits(F.col("text"), HIGH).alias("high"),
                              text.keyword_hits(F.col("text"), LOW).alias("low"))


@query("description_signals", f"""SELECT page_id,
  {hits_sql("lower(html || ' ' || url)", fixed.WRAPPER_PHRASES)} AS desc_fork_wrapper_signals,
  {hits_sql("lower(html || ' ' || url)", fixed.ORIGINAL_PHRASES)} AS desc_originality_signals,
  length(html) AS desc_length FROM pages""")
def description_signals(t: Tables) -> DataFrame:
    found = text.description_signals(F.col("html"), F.col("url"))
    return t.pages.select("page_id", *[c.alias(n) for n, c in found.items()])


@query("readme_signal", f"""SELECT doc_id, greatest(-3, least(5, {hits_sql(LOWERED, HIGH)}
  - {hits_sql(LOWERED, LOW)})) AS signal, greatest(-3, least(5,
  {hits_sql(LOWERED, fixed.README_HIGH)} - {hits_sql(LOWERED, fixed.README_LOW)})) AS published
  FROM documents""")
def readme_signal(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", text.readme_signal(F.col("text"), HIGH, LOW).alias("signal"),
        text.readme_signal(F.col("text")).alias("published"))


DOC_NAME = "source || '-' || (doc_id % 50)"
DOC_LANGUAGE = """CASE lang WHEN 'en' THEN ['Rust','TypeScript','Go'][doc_id % 3 + 1]
  WHEN 'fr' THEN 'C++' WHEN 'de' THEN 'Python' ELSE 'C#' END"""


@query("classify", f"""SELECT doc_id, {rule_sql(LOWERED, "language", "name", 0)} AS category,
  ({rule_sql(LOWERED, "language", "name", 1)})::DOUBLE AS bonus
  FROM (SELECT *, {DOC_NAME} AS name, {DOC_LANGUAGE} AS language FROM documents)""")
def classify(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    language = (F.when(F.col("lang") == "en", F.element_at(
        F.array(F.lit("Rust"), F.lit("TypeScript"), F.lit("Go")), (doc % 3 + 1).cast("int")))
        .when(F.col("lang") == "fr", "C++").when(F.col("lang") == "de", "Python").otherwise("C#"))
    name = F.concat("source", F.lit("-"), doc % 50)
    found = text.classify(name, F.col("text"), F.lit(None).cast("string"), language, RULES, NAMED)
    return t.documents.select("doc_id", found.alias("c")).select("doc_id", "c.*")


def markdown_sql(column: str) -> str:
    for pattern, replacement in fixed.MARKDOWN_STEPS:
        options = "'g'"
        out = quote(replacement.replace("$1", r"\1"))
        if "\n" in replacement:
            out = "chr(10) || chr(10)"
        column = f"regexp_replace({column}, {quote(pattern)}, {out}, {options})"
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


MARKED_SQL = """'# Title ' || doc_id || chr(10) || '![b](x.png) [link](http://a.b/c) **bold** `code`'
  || chr(10) || '| a | b |' || chr(10) || '|---|:--|' || chr(10) || '- item' || chr(10) || '---'
  || chr(10) || chr(10) || chr(10) || '```' || lang || '```' || text || chr(10)"""


def marked_up(t: Tables) -> DataFrame:
    """Documents below a Markdown head that sets off every clean-up step."""
    head = F.concat(
        F.lit("# Title "), F.col("doc_id"), F.lit(
            "\n![b](x.png) [link](http://a.b/c) **bold** `code`\n| a | b |\n|---|:--|\n- item\n---"
            "\n\n\n```"), F.col("lang"), F.lit("```"))
    return t.documents.select("doc_id", F.concat(head, "text", F.lit("\n")).alias("text"))


@query("markdown_strip", f"""SELECT 'd' || doc_id AS id, {markdown_sql("text")} AS text
  FROM (SELECT doc_id, {MARKED_SQL} AS text FROM documents)
  UNION ALL SELECT 'p' || page_id, {markdown_sql("html")} FROM pages""")
def markdown_strip(t: Tables) -> DataFrame:
    docs = marked_up(t).select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    pages = t.pages.select(F.concat(F.lit("p"), F.col("page_id")).alias("id"),
                           F.col("html").alias("text"))
    return docs.unionByName(pages).select("id", text.strip_markdown(F.col("text")).alias("text"))


@query("excerpt", rf"""SELECT doc_id, length(text) >= 80 AS readme_found, CASE WHEN length(text) >= 80
  THEN regexp_replace(substr(text, 1, 800), '^\s+|\s+$', '', 'g') ELSE '' END AS readme_excerpt
  FROM (SELECT doc_id, {markdown_sql("text")} AS text FROM documents)""")
def excerpt(t: Tables) -> DataFrame:
    clean = t.documents.select("doc_id", text.strip_markdown(F.col("text")).alias("clean"))
    return clean.select("doc_id", *[c.alias(n) for n, c in text.excerpt(F.col("clean")).items()])


def bare_sql(name: str) -> str:
    for affix in fixed.NAME_AFFIXES:
        name = f"replace({name}, {quote(affix)}, '')"
    return name


@query("search_terms", f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(
  CASE WHEN rust THEN [name, bare, replace(name, '-', '_'), replace(bare, '-', '_')]
  ELSE [name, bare] END, lambda x: length(x) >= 3))), ',') AS terms
  FROM (SELECT *, {bare_sql("name")} AS bare FROM (SELECT p_partkey, p_size % 2 = 0 AS rust,
    replace(p_name, ' ', '-') || CASE WHEN p_size % 3 = 0 THEN '-rs' WHEN p_size % 3 = 1 THEN '-core'
      ELSE '' END AS name FROM part))""")
def search_terms(t: Tables) -> DataFrame:
    size = F.col("p_size")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")),
                    F.when(size % 3 == 0, "-rs").when(size % 3 == 1, "-core").otherwise(""))
    dep = F.when(size % 5 == 0, name).otherwise(F.concat(F.lower("p_type"), F.lit("/"), name))
    terms = text.search_terms(dep, F.when(size % 2 == 0, "Rust").otherwise("Go"))
    return t.part.select("p_partkey", F.array_join(F.array_sort(terms), ",").alias("terms"))


@query("language_key", f"""SELECT doc_id, {sql_case("lower(trim(label))", fixed.LANGUAGE_LABELS, "''")}
  AS language FROM (SELECT doc_id, {DOC_LANGUAGE} || ' ' AS label FROM documents)""")
def language_key(t: Tables) -> DataFrame:
    label = (F.when(F.col("lang") == "en", F.element_at(
        F.array(F.lit("Rust"), F.lit("TypeScript"), F.lit("Go")),
        (F.col("doc_id") % 3 + 1).cast("int")))
        .when(F.col("lang") == "fr", "C++").when(F.col("lang") == "de", "Python").otherwise("C#"))
    return t.documents.select("doc_id", text.language_key(F.concat(label, F.lit(" ")))
                              .alias("language"))


# ---- paths -------------------------------------------------------------------------------

WEIGHT_SQL = f"""coalesce(list_filter(list_transform(parts[:-2], lambda p:
  CASE WHEN regexp_matches(p, 'test|spec|mock|bench|example') THEN 0.3::DOUBLE
  WHEN list_contains({sql_list(fixed.CORE_DIRS)}, p) THEN 2.0::DOUBLE END),
  lambda w: w IS NOT NULL)[1], 1.0::DOUBLE)"""
BUCKET_SQL = f"""CASE WHEN list_has_any(parts, {sql_list(fixed.TEST_WORDS)}) THEN 'test'
  WHEN list_has_any(parts, {sql_list(fixed.CORE_DIRS)}) THEN 'core' ELSE 'normal' END"""


@query("file_weight", with_views("file_kinds", f"SELECT path, {WEIGHT_SQL} AS weight FROM file_kinds"))
def file_weight(t: Tables) -> DataFrame:
    return t.files.select("path", paths.weight(F.col("path")).alias("weight"))


@query("path_bucket", with_views("file_kinds", f"SELECT path, {BUCKET_SQL} AS bucket FROM file_kinds"))
def path_bucket(t: Tables) -> DataFrame:
    return t.files.select("path", paths.bucket(F.col("path")).alias("bucket"))


@query("skip_dirs", with_views("file_kinds", f"""SELECT path FROM file_kinds
  WHERE NOT list_has_any(parts, {sql_list(fixed.SKIP_DIRS)})"""))
def skip_dirs(t: Tables) -> DataFrame:
    return t.files.filter(~paths.in_skipped_dir(F.col("path"))).select("path")


def ext_sql(values) -> str:
    return f"list_contains({sql_list(values)}, regexp_extract(lower(path), '[.]([^.]*)$', 1))"


@query("tree_stats", with_views("tree", f"""SELECT repo, count(*) FILTER (type = 'blob') AS total_files,
  count(*) FILTER (type = 'tree') AS total_dirs,
  max(length(path) - length(replace(path, '/', ''))) AS tree_depth,
  bool_or({" OR ".join(f"starts_with(path, {quote(p)})" for p in fixed.CI_PATHS)}) AS has_ci_cd,
  bool_or(contains(lower(path), 'dockerfile') OR contains(lower(path), 'docker-compose'))
    AS has_dockerfile,
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
  FROM tree GROUP BY repo"""))
def tree_stats(t: Tables) -> DataFrame:
    return tree_statistics(t.tree)


# ---- arrays, maps, payloads --------------------------------------------------------------

@query("series_tail", """SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total,
  round(list_sum(CAST(embedding[1:label + 1] AS DOUBLE[])), 5) AS own,
  round(list_sum(CAST(embedding[-4:] AS DOUBLE[])) / 4, 5) AS recent,
  CASE WHEN label + 1 >= 4 THEN round(list_sum(CAST(embedding[label - 2:label + 1] AS DOUBLE[])) / 4, 5)
    ELSE 0 END AS own_recent FROM embeddings""")
def series_tail(t: Tables) -> DataFrame:
    everything = F.col("embedding").cast("array<double>")
    own = F.slice(everything, F.lit(1), F.col("label") + 1)
    return t.embeddings.select(
        "vec_id", F.round(payloads.series_sum(everything), 5).alias("total"),
        F.round(payloads.series_sum(own), 5).alias("own"),
        F.round(payloads.recent_mean(everything), 5).alias("recent"),
        F.round(payloads.recent_mean(own), 5).alias("own_recent"))


@query("link_total", """SELECT page_id, CASE WHEN contains(url, '?') THEN page_id * 3 + 1
  ELSE len(string_split(html, '<li>')) END AS total FROM pages""")
def link_total(t: Tables) -> DataFrame:
    header = F.when(F.contains("url", F.lit("?")), F.concat(
        F.lit("<"), "url", F.lit('&page=2>; rel="next", <'), "url", F.lit("&page="),
        F.col("page_id") * 3 + 1, F.lit('>; rel="last"')))
    return t.pages.select("page_id", payloads.link_total(
        header, F.size(F.split("html", "<li>"))).alias("total"))


@query("map_share", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0
  WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS languages_count,
  CASE WHEN l_tax = 0 THEN 0 WHEN l_returnflag = 'R' THEN q + 0 ELSE q + 20 END AS total_code_bytes,
  CASE WHEN l_tax = 0 THEN 0 WHEN l_returnflag = 'R' THEN 100.0
    ELSE round(greatest(q, 20) / (q + 20) * 100, 1) END AS primary_language_pct
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)""")
def map_share(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("bigint").cast("string")
    raw = (F.when(F.col("l_tax") == 0, "{}")
           .when(F.col("l_returnflag") == "R", F.concat(F.lit('{"Rust": '), q, F.lit("}")))
           .otherwise(F.concat(F.lit('{"Go": '), q, F.lit(', "C": 20}'))))
    parsed = F.from_json(raw, "map<string, bigint>")
    shares = payloads.language_shares(parsed)
    shares.pop("languages_detail")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                             *[c.alias(n) for n, c in shares.items()])


@query("graph_counts", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_tax = 0 THEN 0 ELSE CAST(l_quantity AS INT) // 3 END AS direct,
  CASE WHEN l_tax = 0 THEN 0 ELSE l_linenumber - 1 END AS transitive, l_tax <> 0 AS found FROM lineitem""")
def graph_counts(t: Tables) -> DataFrame:
    nodes = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")),
                        lambda i: F.struct(i.alias("n")))
    edges = F.transform(F.sequence(F.lit(1), F.col("l_quantity").cast("int")),
                        lambda i: F.struct((i % 3).alias("fromNode")))
    raw = F.when(F.col("l_tax") != 0, F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges"))))
    parsed = F.from_json(raw, "nodes array<struct<n: int>>, edges array<struct<fromNode: int>>")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                             parsed.alias("g"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                       *[c.alias(n) for n, c in payloads.graph_counts(F.col("g")).items()])


@query("payload_flags", """SELECT o_orderkey, o_custkey % 4 AS release_count,
  CASE WHEN o_custkey % 4 > 0 THEN 'd' || o_orderkey ELSE '' END AS latest_release_date,
  o_custkey % 4 > 0 AS has_releases, o_custkey % 3 AS branch_count,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey % 100 END AS health_percentage,
  o_orderstatus = 'O' AS has_code_of_conduct, o_orderstatus <> 'F' AS has_contributing,
  false AS has_issue_template, false AS has_pull_request_template FROM orders""")
def payload_flags(t: Tables) -> DataFrame:
    key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    number = (cust % 4).cast("int")
    release = F.struct(F.concat(F.lit("d"), key).alias("published_at"))
    releases = F.to_json(F.when(number > 0, F.array_repeat(release, number)).otherwise(
        F.array_repeat(release, 0)))
    branches = F.to_json(F.array_repeat(F.lit("b"), (cust % 3).cast("int")))
    file = F.struct(F.lit("u").alias("url"))
    profile = F.when(status != "F", F.to_json(F.struct(
        (cust % 100).alias("health_percentage"),
        F.struct(F.when(status == "O", file).alias("code_of_conduct"),
                 file.alias("contributing")).alias("files"))))
    doc = ", ".join(f"{n}: struct<url: string>" for n in (
        "code_of_conduct", "contributing", "issue_template", "pull_request_template"))
    rows = t.orders.select(
        "o_orderkey", F.from_json(releases, "array<struct<published_at: string>>").alias("r"),
        F.from_json(branches, "array<string>").alias("b"),
        F.from_json(profile, f"health_percentage bigint, files struct<{doc}>").alias("p"))
    columns = {**payloads.release_columns(F.col("r")),
               "branch_count": payloads.list_length(F.col("b")),
               **payloads.community_columns(F.col("p"))}
    return rows.select("o_orderkey", *[c.alias(n) for n, c in columns.items()])
