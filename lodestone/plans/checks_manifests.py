"""Manifest queries: manifests are rendered from order lines, read back, and compared with
the lines themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import manifests
from .registry import query
from .views import Tables

PART, SUPP, LINE = "'part-' || l_partkey", "'supp-' || l_suppkey", "'line-' || l_linenumber"


def put(*pieces) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def part() -> Column:
    return put("part-", F.col("l_partkey"))


def supp() -> Column:
    return put("supp-", F.col("l_suppkey"))


def line() -> Column:
    return put("line-", F.col("l_linenumber"))


def render(kind: str) -> Column:
    """One manifest per order line."""
    if kind == "toml":
        return put('[package]\nname = "x"\n\n[dependencies]\n# note = 1\n', part(), ' = "1"\n',
                   supp(), ".workspace = true\n\n[dev-dependencies]\n", line(),
                   ' = "2"\n[build-dependencies]\n  cc = "1"\n[profile.release]\nopt = 3\n')
    if kind == "gomod":
        return put("module x\n\nrequire (\n\tgithub.com/acme/", part(),
                   " v1.0.0\n\t// comment v2\n\n\texample.com/", supp(), "/v2 v2.1.0 // indirect\n)\n",
                   "require golang.org/x/", line(), " v0.1.0\n")
    if kind == "godeps":
        return put('{"ImportPath": "x", "Deps": [{"ImportPath": "github.com/acme/', part(),
                   '/sub/dir", "Rev": "1"}, {"ImportPath": "short/', supp(), '"}, {"Rev": "2"}]}')
    if kind == "npm":
        return put('{"name": "x", "dependencies": {"', part(), '": "^1"}, "peerDependencies": {"@s/',
                   supp(), '": "*"}, "optionalDependencies": {}, "devDependencies": {"', line(),
                   '": "1", "jest": "2"}}')
    if kind == "requirements":
        return put("# pinned\n", F.upper(part()), ">=1.0\n\n", supp(), "[extra]==2 ; python_version\n")
    if kind == "pyproject":
        return put('[project]\nname = "x"\ndependencies = [\n  "', part(), '>=1",\n  \'', supp(),
                   "[all]',\n]\n")
    if kind == "dotnet":
        return put('<Project>\n<PackageReference Include="Acme.', part(),
                   '" Version="1" />\n<packagereference  include="', supp(), '"/>\n</Project>')
    raise ValueError(kind)


def rendered(t: Tables, kind: str) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("repo"), render(kind).alias("content"))


def pairs(*named: tuple[str, str]) -> str:
    """SQL for distinct names of every line, each with its dev flag."""
    return "SELECT DISTINCT repo, dep, is_dev FROM (" + " UNION ALL ".join(
        f"SELECT l_orderkey AS repo, {name} AS dep, {dev} AS is_dev FROM lineitem"
        for name, dev in named) + ")"


def snake(name: str) -> str:
    return f"replace({name}, '-', '_')"


NAMES = {
    "toml": [(PART, "false"), (snake(PART), "false"), (SUPP, "false"), (snake(SUPP), "false"),
             (LINE, "true"), (snake(LINE), "true"), ("'cc'", "false")],
    "gomod": [(f"'github.com/acme/' || {PART}", "false"), (f"'example.com/' || {SUPP} || '/v2'", "false"),
              (f"'golang.org/x/' || {LINE}", "false")],
    "godeps": [(f"'github.com/acme/' || {PART} || '/sub/dir'", "false"),
               (f"'github.com/acme/' || {PART}", "false"), (f"'short/' || {SUPP}", "false")],
    "npm": [(PART, "false"), (f"'@s/' || {SUPP}", "false"), (LINE, "true"), ("'jest'", "true")],
    "requirements": [(snake(PART), "false"), (snake(SUPP), "false")],
    # A closing quote opens a match too, so the comma after it is read as a name.
    "pyproject": [(snake(PART), "false"), (snake(SUPP), "false"), ("','", "false")],
    "dotnet": [(f"'Acme.' || {PART}", "false"), (f"'acme.' || {PART}", "false"),
               (f"'acme_' || {snake(PART)}", "false"), (SUPP, "false"), (snake(SUPP), "false")],
}


def register(name: str, kind: str) -> None:
    @query(name, pairs(*NAMES[kind]))
    def run(t: Tables) -> DataFrame:
        return manifests.extract(rendered(t, kind), kind)


for _name, _kind in [("manifest_toml", "toml"), ("manifest_gomod", "gomod"),
                     ("manifest_godeps", "godeps"), ("manifest_npm", "npm"),
                     ("manifest_python", "requirements"), ("manifest_pyproject", "pyproject"),
                     ("manifest_dotnet", "dotnet")]:
    register(_name, _kind)

FILE_NAMES = {"toml": "Cargo.toml", "gomod": "go.mod", "godeps": "Godeps.json",
              "npm": "package.json", "requirements": "requirements-dev.txt",
              "pyproject": "pyproject.toml", "dotnet": "x.fsproj"}


def mixed(t: Tables) -> DataFrame:
    """Manifests of every kind, the kind by line number; some below skipped folders."""
    number = F.col("l_linenumber") % len(FILE_NAMES)
    path = content = None
    for i, (kind, name) in enumerate(FILE_NAMES.items()):
        folder = F.when(F.col("l_returnflag") == "R", "vendor/").otherwise("app/")
        p, c = put(folder, name), render(kind)
        path = F.when(number == i, p) if path is None else path.when(number == i, p)
        content = F.when(number == i, c) if content is None else content.when(number == i, c)
    return t.lineitem.select(F.col("l_orderkey").alias("repo"), path.alias("path"),
                             content.alias("content"))


def union_sql() -> str:
    arms = []
    for i, kind in enumerate(FILE_NAMES):
        skipped = " AND l_returnflag <> 'R'" if kind in ("toml", "gomod") else ""
        for name, dev in NAMES[kind]:
            arms.append(f"SELECT l_orderkey AS repo, {name} AS dep, {dev} AS is_dev FROM lineitem "
                        f"WHERE l_linenumber % {len(FILE_NAMES)} = {i}{skipped}")
    return "SELECT DISTINCT repo, dep, is_dev FROM (" + " UNION ALL ".join(arms) + ")"


@query("manifest_union", union_sql())
def manifest_union(t: Tables) -> DataFrame:
    return manifests.extract_all(mixed(t))


@query("lock_packages", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linenumber - 1
  AS cargo_lock_total_packages, greatest(l_linenumber - 2, 0) AS cargo_lock_external_estimate,
  true AS cargo_lock_found FROM lineitem""")
def lock_packages(t: Tables) -> DataFrame:
    body = F.repeat(put('[[package]]\nname = "', part(), '"\n\n'), F.col("l_linenumber") - 1)
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                             put("version = 3\n", body).alias("content"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[
        c.alias(n) for n, c in manifests.lock_packages(F.col("content")).items()])


@query("sum_modules", """SELECT repo, count(DISTINCT m) AS go_sum_unique_modules FROM (
  SELECT l_orderkey AS repo, 'github.com/acme/' || l_partkey AS m FROM lineitem
  UNION ALL SELECT l_orderkey, 'example.com/' || l_suppkey FROM lineitem) GROUP BY repo""")
def sum_modules(t: Tables) -> DataFrame:
    content = put("github.com/acme/", F.col("l_partkey"), " v1.0.0 h1:abc=\ngithub.com/acme/",
                  F.col("l_partkey"), " v1.0.0/go.mod h1:def=\n\n// note here\nalone\n  example.com/",
                  F.col("l_suppkey"), "\tv2 h1:x=\n")
    return manifests.checksum_modules(
        t.lineitem.select(F.col("l_orderkey").alias("repo"), content.alias("content")))


def counted(t: Tables) -> DataFrame:
    """Texts for the cheap counters: the kind by part, the number of entries by line number."""
    n, d = F.col("l_linenumber"), F.col("l_quantity").cast("int") % 4

    def entries(text, number):
        return F.repeat(F.lit(text), number)

    names = F.transform(F.sequence(F.lit(1), n), lambda i: put('"d', i, '": "1"'))
    devs = F.transform(F.sequence(F.lit(1), d + 1), lambda i: put('"v', i, '": "1"'))
    texts = {
        "npm": put('{"dependencies": {', F.array_join(names, ","), '}, "peerDependencies": {',
                   F.array_join(devs, ","), "}}"),
        "cargo": put('[package]\nname = "x"\n[dependencies]\n# a = 1\n', entries('a = "1"\n', n),
                     "[build-dependencies]\n", entries('b = "1"\n', d + 1), '[features]\nc = "1"\n'),
        "go": put("module x\nrequire (\n", entries("\ta v1\n", n), "\t// c\n\n)\n",
                  entries("require b v1\n", d + 1)),
        "pip": put("# c\n-r x.txt\n\n", entries("a==1\n", n)),
        "maven": put("<x>", entries("<dependency></dependency>\n", n), "</x>"),
        "gradle": put("plugins\n", entries("  implementation 'a'\n", n), entries("api(b)\n", d + 1)),
        "elixir": put("defp deps do [", entries('{:a, "1"},', n), "]"),
        "haskell": F.when(d == 0, entries("build-depends: a\n", n)).otherwise(entries("- a\n", n)),
        "ruby": entries("gem 'a'\n", n),
    }
    which = F.col("l_partkey") % len(texts)
    kind = content = None
    for i, (name, text) in enumerate(texts.items()):
        kind = F.when(which == i, name) if kind is None else kind.when(which == i, name)
        content = F.when(which == i, text) if content is None else content.when(which == i, text)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                             kind.alias("kind"), content.alias("content"))


D1 = "CAST(l_quantity AS INT) % 4 + 1"
PROD_SQL = f"""CASE l_partkey % 9 WHEN 2 THEN l_linenumber + {D1} WHEN 5 THEN l_linenumber + {D1}
  WHEN 8 THEN 0 ELSE l_linenumber END"""
DEV_SQL = f"CASE WHEN l_partkey % 9 IN (0, 1) THEN {D1} ELSE 0 END"


@query("manifest_counts", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  {PROD_SQL} AS prod, {DEV_SQL} AS dev FROM lineitem""")
def manifest_counts(t: Tables) -> DataFrame:
    found = F.inline(F.array(manifests.counted(F.col("kind"), F.col("content"))))
    return counted(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", found)


COUNTED_NAMES = {"npm": "package.json", "cargo": "Cargo.toml", "go": "go.mod",
                 "pip": "setup.cfg", "maven": "pom.xml", "gradle": "build.gradle",
                 "elixir": "mix.exs", "haskell": "stack.yaml", "ruby": "Gemfile"}


@query("manifest_rollup", f"""SELECT repo, CAST(sum(p) AS BIGINT) AS dependency_count,
  CAST(sum(d) AS BIGINT) AS dev_dependency_count, string_agg(name, ',' ORDER BY ord) AS dep_files_found,
  string_agg(eco, ',' ORDER BY eco) AS dep_ecosystems, count(*) AS dep_ecosystem_count
  FROM (SELECT l_orderkey AS repo, l_partkey % 9 AS k, sum({PROD_SQL}) AS p, sum({DEV_SQL}) AS d
    FROM lineitem GROUP BY 1, 2)
  JOIN (VALUES (0, 'package.json', 'npm', 0), (1, 'Cargo.toml', 'cargo', 1), (2, 'go.mod', 'go', 2),
    (3, 'setup.cfg', 'pip', 6), (8, 'Gemfile', 'ruby', 9), (4, 'pom.xml', 'maven', 10),
    (5, 'build.gradle', 'gradle', 11), (6, 'mix.exs', 'elixir', 13), (7, 'stack.yaml', 'haskell', 15))
    v(kind, name, eco, ord) ON kind = k GROUP BY repo""")
def manifest_rollup(t: Tables) -> DataFrame:
    from ..functions.numeric import lookup

    files = counted(t).select(F.col("l_orderkey").alias("repo"),
                              lookup(F.col("kind"), COUNTED_NAMES, None).alias("name"), "content")
    return manifests.manifest_rollup(files)
