"""Views that bind the operators to the test tables, in Spark and in SQL.

Every view covers its whole tables. What a table lacks (manifests, source code, payloads)
is rendered from its rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import lookup
from ..session import cut_lineage

AS_OF = "2005-01-01T00:00:00Z"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

DIRS = ["src", "lib", "test", "spec_x", "docs", "vendor", "example", "pkg"]
EXTS = [".rs", ".go", ".py", ".ts", ".js", ".java", ".cs", ".rb", ".nim", ".cpp", ".txt"]
TERMS = ["the", "les", "der", "que", "en"]
DEPS = [
    ("acme/the", ["the"]),
    ("acme/les", ["les", "los"]),
    ("acme/der-rs", ["der-rs", "der"]),
    ("acme/que", ["que", "acme/que"]),
    ("acme/en-core", ["en-core", "en"]),
    ("acme/unused", ["qzqzqz"]),
]
RULES = [
    ("zk_system", 0.06, ["ción", "un la"], []),
    ("compiler_language", 0.06, ["eau le", "ou le"], []),
    ("execution_client", 0.05, ["the of"], ["Go", "Rust", "C++", "C#"]),
    ("consensus_client", 0.05, ["sch"], []),
    ("crypto_primitive", 0.05, ["by the", "than the"], []),
    ("smart_contract", 0.02, ["it is"], []),
    ("spec_standard", 0.03, ["is and"], []),
    ("dev_tooling", 0.01, ["tion the"], []),
    ("config_infra", -0.04, ["for and", "ther and"], []),
    ("data_repo", -0.06, ["with the"], []),
]
NAMED = {"dev_tooling": ["src3-7"], "data_repo": ["src1-21", "src2-2"]}
HIGH = ["tion the", "the of", "und", "que", "los", "on the"]
LOW = ["ing of", "and re", "with the", "ver"]

VIEWS: dict[str, str] = {}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_case(column: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def with_views(names: str, body: str) -> str:
    """``body`` behind the named views and those they need."""
    wanted: list[str] = []

    def need(name):
        if name in wanted:
            return
        text = VIEWS[name]
        for other in VIEWS:
            if other != name and f"{{{other}}}" in text:
                need(other)
        wanted.append(name)

    for name in names.split():
        need(name)
    parts = []
    for name in wanted:
        text = VIEWS[name]
        for other in VIEWS:
            text = text.replace(f"{{{other}}}", other)
        parts.append(f"{name} AS ({text})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


class Tables:
    """The test tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with their customer."""
        return self.lineitem.join(self.orders.select("o_orderkey", "o_custkey"),
                                  F.col("l_orderkey") == F.col("o_orderkey"))

    def settle_lines(self) -> None:
        """Order lines with their customer as a written table, for plans that read them often."""
        self.__dict__["lines"] = cut_lineage(self.lines.drop("o_orderkey", "l_shipdate"))

    @cached_property
    def edges(self) -> DataFrame:
        """Dependency graph: customers pointing at customers, a tenth of the ends unknown."""
        known = self.customer.agg(F.count(F.lit(1)).alias("n")).scalar()
        target = F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.floor(known * 11 / 10))
        return self.lines.select(F.col("o_custkey").alias("src"), target.alias("dst"))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("id"))

    @cached_property
    def projects(self) -> DataFrame:
        """One wide row per project, counts of several partial sources."""
        per_supplier = self.lines.groupBy("o_custkey", "l_suppkey").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
            F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
            F.count_if(F.col("l_returnflag") == "N").alias("n_n"),
            F.count_if(F.col("l_linenumber") == 1).alias("n_first"),
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
        lines = per_supplier.groupBy("o_custkey").agg(
            F.sum("n").alias("n"), F.sum("n_r").alias("n_r"), F.sum("n_a").alias("n_a"),
            F.sum("n_n").alias("n_n"), F.sum("n_first").alias("n_first"), F.sum("cents").alias("cents"),
            F.count(F.lit(1)).alias("contributors"))
        placed = self.orders.groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("created"), F.max("o_orderdate").alias("pushed"),
            F.count(F.lit(1)).alias("stars"))
        docs = self.documents.select(
            F.col("doc_id").alias("c_custkey"), F.col("text").alias("description"), "lang",
            F.concat(F.col("source"), F.lit("-"), F.col("doc_id") % 50).alias("doc_name"))
        base = (self.customer
                .join(lines.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
                .join(placed.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
                .join(docs, "c_custkey", "left"))
        seg, key = F.col("c_mktsegment"), F.col("c_custkey")

        def where(condition, column):
            return F.when(condition, F.coalesce(F.col(column), F.lit(0))).otherwise(0)

        language = (F.when(F.col("lang") == "en", F.element_at(
            F.array(F.lit("Rust"), F.lit("TypeScript"), F.lit("Go")), (key % 3 + 1).cast("int")))
            .when(F.col("lang") == "fr", "C++").when(F.col("lang") == "de", "Python")
            .when(F.col("lang") == "es", "C#"))
        return base.select(
            key.alias("id"),
            F.concat(F.lit("https://github.com/"), seg, F.lit("/"),
                     F.replace("c_name", F.lit("#"), F.lit("-"))).alias("repo_url"),
            F.col("doc_name").alias("repo_name"), "description", language.alias("language"),
            F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
            F.date_format("pushed", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pushed_at"),
            F.coalesce("stars", F.lit(0)).alias("stars"),
            F.coalesce("n", F.lit(0)).alias("commits_last_year"),
            F.coalesce("contributors", F.lit(0)).alias("contributor_count"),
            F.coalesce("cents", F.lit(0)).alias("total_code_bytes"),
            where(seg == "AUTOMOBILE", "n").alias("graph_dep_count"),
            where(seg == "MACHINERY", "n").alias("cargo_lock_total_packages"),
            where((seg == "BUILDING") | ((seg == "AUTOMOBILE") & (F.col("c_acctbal") < 0)),
                  "n_r").alias("go_sum_unique_modules"),
            where((seg == "FURNITURE") | (F.col("c_acctbal") > 5000), "n_a")
            .alias("depsdev_transitive_deps"),
            F.coalesce("n_n", F.lit(0)).alias("depsdev_direct_deps"),
            F.when(key % 3 > 0, F.col("n_first")).alias("graph_direct_count"),
            F.when(seg == "FURNITURE", "MAVEN,NPM").when(seg == "HOUSEHOLD", "NPM")
            .alias("depsdev_ecosystem"),
            where(seg == "HOUSEHOLD", "n").alias("dependency_count"),
            (F.col("c_acctbal") > 9000).alias("has_benchmarks"))

    @cached_property
    def usage(self) -> DataFrame:
        """Usage table: one row per order line."""
        return self.lines.select(
            F.col("o_custkey").alias("repo"), F.col("l_partkey").alias("dependency"),
            F.round(F.col("l_quantity") * F.col("l_discount"), 2).alias("weighted_score"),
            (F.col("l_returnflag") == "R").alias("manifest_match"),
            (F.col("l_linestatus") == "O").alias("source_match"),
            F.col("l_linenumber").cast("bigint").alias("total_imports"),
            F.col("l_quantity").cast("bigint").alias("total_calls"),
            F.when(F.col("l_tax") >= 0.075, F.lit(-1)).otherwise(F.col("l_quantity"))
            .cast("bigint").alias("file_count"))

    @cached_property
    def signals(self) -> DataFrame:
        """Model signals per user, as shares of events above a value."""
        def rate(kind):
            return F.avg(F.when(F.col("event_type") == kind,
                                F.when(F.col("value") >= 50, 1.0).otherwise(0.0)))

        return self.events.groupBy("user_id").agg(
            rate("click").alias("implements_from_scratch"),
            rate("view").alias("defines_new_protocol"),
            rate("signup").alias("has_novel_algorithms"),
            rate("purchase").alias("is_wrapper_or_integration"),
            rate("error").alias("is_template_or_scaffold"))

    @cached_property
    def files(self) -> DataFrame:
        """Source corpus: one file per document."""
        doc = F.col("doc_id")

        def pick(values, index):
            return F.element_at(F.array(*[F.lit(v) for v in values]),
                                (F.pmod(index, F.lit(len(values))) + 1).cast("int"))

        path = F.concat(pick(DIRS, doc), F.lit("/"), F.col("lang"), F.lit("/"),
                        doc.cast("string"), pick(EXTS, F.floor(doc / 8)))
        return self.documents.select("doc_id", F.col("source").alias("repo"), path.alias("path"),
                                     F.col("text").alias("content"), "n_chars")

    @cached_property
    def code(self) -> DataFrame:
        """Source corpus rendered as code: imports of one term, then the whole text with
        sentence ends turned to calls and line ends to calls on the import's name."""
        doc = F.col("doc_id")
        term = F.element_at(F.array(*[F.lit(v) for v in TERMS]),
                            (F.pmod(doc, F.lit(len(TERMS))) + 1).cast("int"))
        alias = F.concat(F.lit("al"), (doc % 7).cast("string"))
        ext = F.substring_index("path", ".", -1)
        nl = "\n"

        def text(*pieces):
            return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in pieces])

        head = (F.when(ext == "rs", text("use ", term, "::x;", nl, "extern crate ", term, ";", nl,
                                         "#[derive(", term, ", Debug)]", nl))
                .when(ext == "go", text('import "github.com/acme/', term, '/v2"', nl, alias,
                                        ' "github.com/acme/', term, '"', nl))
                .when(ext == "py", text("import ", term, " as ", alias, nl, "from ", term,
                                        " import x as b", alias, nl, "import ", term, nl))
                .when(ext.isin("ts", "js"), text(
                    "import * as ", alias, " from '", term, "'", nl, "const c", alias,
                    " = require('", term, "/sub')", nl, "import type from '@acme/", term, "'", nl))
                .when(ext == "java", text("import org.", term, ";", nl))
                .when(ext == "cs", text("using Org.", term, ";", nl))
                .when(ext == "rb", text("require 'lib/", term, "'", nl))
                .when(ext == "nim", text("import std/", term, nl))
                .otherwise(text('#include "lib/', term, '.h"', nl)))
        plain = F.regexp_replace("content", r"[^\x00-\x7F]", "q")
        call = F.when(ext == "rs", "::call(").otherwise(".call(")
        body = F.replace(F.replace(plain, F.lit(". "), call), F.lit(nl),
                         F.concat(F.lit(nl), alias, F.lit(".run(")))
        return self.files.select("doc_id", "repo", "path", F.concat(head, body).alias("content"))

    @cached_property
    def deps(self) -> DataFrame:
        """Declared dependencies of every source."""
        declared = F.array(*[F.struct(F.lit(d).alias("dep"), F.array(*[F.lit(t) for t in ts])
                                      .alias("terms")) for d, ts in DEPS])
        return (self.documents.select(F.col("source").alias("repo")).distinct()
                .select("repo", F.inline(declared)))

    @cached_property
    def code_manifests(self) -> DataFrame:
        """One small manifest per document."""
        doc = F.col("doc_id")
        term = F.element_at(F.array(*[F.lit(v) for v in TERMS]),
                            (F.pmod(doc, F.lit(len(TERMS))) + 1).cast("int"))
        cargo = F.concat(F.lit("[dev-dependencies]\n"), term, F.lit(" = \"1\"\n"))
        gomod = F.concat(F.lit("require (\n\tgithub.com/acme/"), term, F.lit("-rs/v2 v1\n)\n"))
        is_go = (F.col("lang") == "fr") & (F.col("n_chars") > 3000)
        return self.documents.select(
            F.col("source").alias("repo"),
            F.concat(F.lit("m"), doc.cast("string"), F.when(is_go, "/go.mod")
                     .otherwise("/Cargo.toml")).alias("path"),
            F.when(is_go, gomod).otherwise(cargo).alias("content"))

    @cached_property
    def tree(self) -> DataFrame:
        """File trees: documents as entries under telling names."""
        doc = F.col("doc_id")
        return self.documents.select(
            F.col("source").alias("repo"),
            F.concat(lookup((doc % 17).cast("string"), TREE_NAMES, "src/"),
                     doc.cast("string"),
                     lookup((doc % 5).cast("string"), TREE_EXT, ".rs")).alias("path"),
            F.when(doc % 9 == 0, "tree").otherwise("blob").alias("type"),
            F.col("n_chars").alias("size"), doc.alias("ord"))

    @cached_property
    def anchors(self) -> DataFrame:
        """Labelled projects."""
        target = F.lit(0.35) + F.col("quality") * 0.40 + (F.lit(1) - F.col("toxic")) * 0.10
        return self.labels.select(F.col("doc_id").alias("id"), F.round(target, 2).alias("target"))


TREE_NAMES = {
    "0": "README", "1": "docs/d", "2": "tests/t", "3": ".github/workflows/w",
    "4": "examples/e", "5": "benchmark/b", "6": "deploy/Dockerfile", "7": "latest/x",
    "8": "spec/s", "9": "a/b/c/d/e", "10": "config/c",
}
TREE_EXT = {"0": ".py", "1": ".toml", "2": ".md", "3": "", "4": ".Go"}

VIEWS["lines"] = "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
VIEWS["edges"] = """SELECT o_custkey AS src, (l_partkey * 7 + l_suppkey)
  % CAST(floor((SELECT count(*) FROM customer) * 11 / 10) AS BIGINT) AS dst FROM {lines}"""
VIEWS["nodes"] = "SELECT c_custkey AS id FROM customer"
VIEWS["known_edges"] = """SELECT src, dst FROM {edges}
  WHERE src IN (SELECT id FROM {nodes}) AND dst IN (SELECT id FROM {nodes})"""
VIEWS["line_counts"] = """SELECT o_custkey, count(*) AS n,
  count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) FILTER (l_returnflag = 'A') AS n_a,
  count(*) FILTER (l_returnflag = 'N') AS n_n, count(*) FILTER (l_linenumber = 1) AS n_first,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
  count(DISTINCT l_suppkey) AS contributors FROM {lines} GROUP BY o_custkey"""
VIEWS["order_counts"] = """SELECT o_custkey, min(o_orderdate) AS created, max(o_orderdate) AS pushed,
  count(*) AS stars FROM orders GROUP BY o_custkey"""
VIEWS["projects"] = """SELECT c_custkey AS id,
  'https://github.com/' || c_mktsegment || '/' || replace(c_name, '#', '-') AS repo_url,
  source || '-' || (doc_id % 50) AS repo_name, text AS description,
  CASE lang WHEN 'en' THEN ['Rust','TypeScript','Go'][c_custkey % 3 + 1] WHEN 'fr' THEN 'C++'
    WHEN 'de' THEN 'Python' WHEN 'es' THEN 'C#' END AS language,
  created, pushed, coalesce(stars, 0) AS stars, coalesce(n, 0) AS commits_last_year,
  coalesce(contributors, 0) AS contributor_count, coalesce(cents, 0) AS total_code_bytes,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN coalesce(n, 0) ELSE 0 END AS graph_dep_count,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN coalesce(n, 0) ELSE 0 END AS cargo_lock_total_packages,
  CASE WHEN c_mktsegment = 'BUILDING' OR (c_mktsegment = 'AUTOMOBILE' AND c_acctbal < 0)
    THEN coalesce(n_r, 0) ELSE 0 END AS go_sum_unique_modules,
  CASE WHEN c_mktsegment = 'FURNITURE' OR c_acctbal > 5000
    THEN coalesce(n_a, 0) ELSE 0 END AS depsdev_transitive_deps,
  coalesce(n_n, 0) AS depsdev_direct_deps,
  CASE WHEN c_custkey % 3 > 0 THEN n_first END AS graph_direct_count,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'MAVEN,NPM' WHEN 'HOUSEHOLD' THEN 'NPM' END
    AS depsdev_ecosystem,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN coalesce(n, 0) ELSE 0 END AS dependency_count,
  c_acctbal > 9000 AS has_benchmarks
  FROM customer LEFT JOIN {line_counts} lc ON lc.o_custkey = c_custkey
  LEFT JOIN {order_counts} oc ON oc.o_custkey = c_custkey LEFT JOIN documents ON doc_id = c_custkey"""
VIEWS["usage"] = """SELECT o_custkey AS repo, l_partkey AS dependency,
  round(l_quantity * l_discount, 2) AS weighted_score, l_returnflag = 'R' AS manifest_match,
  l_linestatus = 'O' AS source_match, CAST(l_linenumber AS BIGINT) AS total_imports,
  CAST(l_quantity AS BIGINT) AS total_calls,
  CASE WHEN l_tax >= 0.075 THEN -1 ELSE CAST(l_quantity AS BIGINT) END AS file_count FROM {lines}"""
VIEWS["signals"] = "SELECT user_id, " + ", ".join(
    f"avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END) FILTER (event_type = '{k}') AS {n}"
    for k, n in [("click", "implements_from_scratch"), ("view", "defines_new_protocol"),
                 ("signup", "has_novel_algorithms"), ("purchase", "is_wrapper_or_integration"),
                 ("error", "is_template_or_scaffold")]) + " FROM events GROUP BY user_id"
VIEWS["files"] = f"""SELECT doc_id, source AS repo, {sql_list(DIRS)}[doc_id % {len(DIRS)} + 1] || '/'
  || lang || '/' || doc_id || {sql_list(EXTS)}[(doc_id // 8) % {len(EXTS)} + 1] AS path,
  text AS content, n_chars FROM documents"""
VIEWS["file_kinds"] = f"""SELECT *, string_split(lower(path), '/') AS parts,
  {sql_case("lower(regexp_extract(path, '[.]([^.]*)$', 1))", {
      "rs": "rust", "go": "go", "py": "python", "ts": "typescript", "js": "javascript",
      "java": "java", "cs": "csharp", "rb": "ruby", "nim": "nim", "cpp": "cpp"}, "NULL")} AS language
  FROM {{files}}"""
VIEWS["code_head"] = f"""SELECT doc_id, repo, path, content, language,
  {sql_list(TERMS)}[doc_id % {len(TERMS)} + 1] AS t, 'al' || (doc_id % 7) AS a, chr(10) AS nl
  FROM {{file_kinds}}"""
VIEWS["code"] = r"""SELECT doc_id, repo, path, language,
  CASE WHEN language = 'rust' THEN 'use ' || t || '::x;' || nl || 'extern crate ' || t || ';' || nl
      || '#[derive(' || t || ', Debug)]' || nl
    WHEN language = 'go' THEN 'import "github.com/acme/' || t || '/v2"' || nl || a
      || ' "github.com/acme/' || t || '"' || nl
    WHEN language = 'python' THEN 'import ' || t || ' as ' || a || nl || 'from ' || t
      || ' import x as b' || a || nl || 'import ' || t || nl
    WHEN language IN ('typescript', 'javascript') THEN 'import * as ' || a || ' from ''' || t || ''''
      || nl || 'const c' || a || ' = require(''' || t || '/sub'')' || nl
      || 'import type from ''@acme/' || t || '''' || nl
    WHEN language = 'java' THEN 'import org.' || t || ';' || nl
    WHEN language = 'csharp' THEN 'using Org.' || t || ';' || nl
    WHEN language = 'ruby' THEN 'require ''lib/' || t || '''' || nl
    WHEN language = 'nim' THEN 'import std/' || t || nl
    ELSE '#include "lib/' || t || '.h"' || nl END
  || replace(replace(regexp_replace(content, '[^\x00-\x7F]', 'q', 'g'), '. ',
    CASE WHEN language = 'rust' THEN '::call(' ELSE '.call(' END), nl, nl || a || '.run(')
  AS content FROM {code_head}"""
VIEWS["deps"] = "SELECT repo, dep, terms FROM (SELECT DISTINCT source AS repo FROM documents), (VALUES " \
    + ", ".join(f"({quote(d)}, {sql_list(ts)})" for d, ts in DEPS) + ") v(dep, terms)"
VIEWS["code_names"] = f"""SELECT DISTINCT source AS repo,
  CASE WHEN lang = 'fr' AND n_chars > 3000
    THEN 'github.com/acme/' || {sql_list(TERMS)}[doc_id % {len(TERMS)} + 1] || '-rs/v2'
    ELSE {sql_list(TERMS)}[doc_id % {len(TERMS)} + 1] END AS dep,
  NOT (lang = 'fr' AND n_chars > 3000) AS is_dev FROM documents"""
VIEWS["tree"] = f"""SELECT source AS repo,
  {sql_case("CAST(doc_id % 17 AS VARCHAR)", TREE_NAMES, "'src/'")} || doc_id
  || {sql_case("CAST(doc_id % 5 AS VARCHAR)", TREE_EXT, "'.rs'")} AS path,
  CASE WHEN doc_id % 9 = 0 THEN 'tree' ELSE 'blob' END AS type, n_chars AS size, doc_id AS ord
  FROM documents"""
VIEWS["anchors"] = """SELECT doc_id AS id, round(0.35 + quality * 0.40 + (1 - toxic) * 0.10, 2)::DOUBLE AS target
  FROM labels"""
