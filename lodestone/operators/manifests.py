"""Declared dependencies out of manifests and lock files.

Every extractor is a struct over one manifest's text, of production names ``prod`` and
development names ``dev``, so that a text is parsed once for both. Texts stay in the scan
stage; only names are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.keys import trim_all
from ..functions.numeric import bound, lookup
from ..functions.paths import parts, words
from ..session import cut_lineage
from .containment import contained
from .joins import normalised

# Formats of manifest lines and blocks. ``(?d)`` makes only "\n" end a line.
TOML_PROD_BLOCK = r"(?dm)^\[(?:build-)?dependencies(?:\.[^\]]+)?\]((?:[^\n]++|\n(?!\[))*+)"
TOML_DEV_BLOCK = r"(?dm)^\[dev-dependencies(?:\.[^\]]+)?\]((?:[^\n]++|\n(?!\[))*+)"
TOML_ENTRY = r"(?dm)^[^\S\n]*([a-zA-Z0-9_\-]+)[^\S\n]*[=.]"
GO_BLOCK = r"require\s*\(([^)]+)\)"
GO_BLOCK_ENTRY = r"(?dm)^[^\S\n]*(?!//)(\S+)"
GO_SINGLE = r"(?dm)^require\s+([\w./\-]+)\s+v"
PIP_NAME = r"(?dm)^[^\S\n]*+(?!#)([^>=<!;\[\n]+)"
PYPROJECT_BLOCK = r"(?dms)^dependencies\s*=\s*\[([^\]]+)\]"
PYPROJECT_NAME = r"[\"']([^\"'>=<!;\[]+)"
DOTNET_REFERENCE = r'(?i)<PackageReference\s+Include="([^"]+)"'
ELIXIR_ENTRY = r"\{:\w+,"
LIST_ENTRY = r"- \w+"

# Folders whose manifests do not count.
MANIFEST_SKIP = {
    "cargo": ["vendor", ".cargo", "target"],
    "go": ["vendor", "testdata"],
    "npm": ["node_modules", ".cache"],
}


def empty() -> Column:
    return F.array().cast("array<string>")


def both(prod: Column, dev: Column | None = None) -> Column:
    return F.struct(prod.alias("prod"), (empty() if dev is None else dev).alias("dev"))


def numbers(prod: Column, dev: Column | None = None) -> Column:
    none = F.lit(0) if dev is None else F.coalesce(dev, F.lit(0))
    return F.struct(F.coalesce(prod, F.lit(0)).cast("int").alias("prod"), none.cast("int").alias("dev"))


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def with_variant(names: Column, *variants) -> Column:
    """Names plus other spellings of each."""
    spelled = F.transform(names, lambda n: F.array(n, *[v(n) for v in variants]))
    return F.array_distinct(F.flatten(spelled))


def snake(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def toml_names(text: Column) -> Column:
    """Keys of dependency tables; build dependencies count as production.

    A table per dependency, ``[dependencies.x]``, yields its own keys, not ``x``.
    """
    def names(block):
        found = F.flatten(F.transform(every(text, block), lambda b: every(b, TOML_ENTRY)))
        return with_variant(found, snake)

    return both(names(TOML_PROD_BLOCK), names(TOML_DEV_BLOCK))


def gomod_names(text: Column) -> Column:
    blocks = F.flatten(F.transform(every(text, GO_BLOCK), lambda b: every(b, GO_BLOCK_ENTRY)))
    return both(F.array_union(blocks, every(text, GO_SINGLE)))


def read_json(text: Column, quick, slow) -> Column:
    """``quick(variant)`` of a text that is strict JSON with an object at its root, where it is
    not null; of any other text ``slow(text)``, by ``from_json``, which reads more and costs a
    multiple."""
    strict = F.when(text.rlike(r"\A\s*+\{"), F.try_parse_json(text))
    return bound(strict, lambda v: F.coalesce(F.when(v.isNotNull(), quick(v)), slow(text)))


def godeps_names(text: Column) -> Column:
    """Import paths and their first three segments; shorter paths have no other form."""
    def quick(v):
        # only where every path is a string: of other values the spelling would change
        listed = F.try_variant_get(v, "$.Deps", "variant")
        plain = F.schema_of_variant(listed).rlike(r"\AARRAY<OBJECT<[^<`]*\bImportPath: STRING[,>]")
        return F.when(plain, F.try_variant_get(listed, "$", "array<struct<ImportPath: string>>")["ImportPath"])

    def slow(text):
        parsed = F.from_json(text, "Deps array<struct<ImportPath: string>>")
        return F.coalesce(parsed["Deps"]["ImportPath"], empty())

    found = F.filter(read_json(text, quick, slow), lambda p: p.isNotNull() & (p != ""))
    return both(with_variant(found, lambda p: F.substring_index(p, "/", 3)))


NPM_FIELDS = ("dependencies", "peerDependencies", "optionalDependencies", "devDependencies")
NPM_SCHEMA = ", ".join(f"{f} map<string, string>" for f in NPM_FIELDS)


def npm_names(text: Column) -> Column:
    def listed(maps):
        def keys(*fields):
            each = F.array(*[F.map_keys(maps(f)) for f in fields])
            return F.array_distinct(F.flatten(F.array_compact(each)))

        return both(keys(*NPM_FIELDS[:3]), keys(NPM_FIELDS[3]))

    def quick(v):
        return listed(lambda f: F.try_variant_get(v, f"$.{f}", "map<string, variant>"))

    return read_json(text, quick, lambda t: bound(F.from_json(t, NPM_SCHEMA), lambda p: listed(lambda f: p[f])))


def requirements_names(text: Column) -> Column:
    found = F.transform(every(text, PIP_NAME), lambda n: snake(F.lower(trim_all(n))))
    return both(F.array_distinct(F.filter(found, lambda n: n != "")))


def pyproject_names(text: Column) -> Column:
    found = F.flatten(F.transform(every(text, PYPROJECT_BLOCK),
                                  lambda b: every(b, PYPROJECT_NAME)))
    return both(F.array_distinct(F.transform(found, lambda n: snake(F.lower(trim_all(n))))))


def dotnet_names(text: Column) -> Column:
    found = F.transform(every(text, DOTNET_REFERENCE), trim_all)
    return both(with_variant(found, F.lower, lambda n: F.translate(F.lower(n), ".-", "__")))


def manifest_kind(path: Column) -> Column:
    """Which extractor reads a file; null where none does."""
    def outside(kind):
        return ~F.arrays_overlap(parts(path), words(MANIFEST_SKIP[kind]))

    return bound(F.substring_index(path, "/", -1), lambda name: (
        F.when((name == "Cargo.toml") & outside("cargo"), "toml")
        .when((name == "go.mod") & outside("go"), "gomod")
        .when(name == "Godeps.json", "godeps")
        .when((name == "package.json") & outside("npm"), "npm")
        .when(name.rlike(r"^requirements.*\.txt$"), "requirements")
        .when(name == "pyproject.toml", "pyproject")
        .when(name.rlike(r"\.(csproj|fsproj)$"), "dotnet")))


EXTRACTORS = {
    "toml": toml_names,
    "gomod": gomod_names,
    "godeps": godeps_names,
    "npm": npm_names,
    "requirements": requirements_names,
    "pyproject": pyproject_names,
    "dotnet": dotnet_names,
}


def coded(dep: Column) -> tuple[Column, Column]:
    """A name as a spelling without dashes, where it has no underscore, and which of the two
    it is: 1 the spelling itself, 2 the one with dashes. Different names differ in one of them."""
    dashed = F.contains(dep, F.lit("-")) & ~F.contains(dep, F.lit("_"))
    return F.when(dashed, snake(dep)).otherwise(dep), F.when(dashed, 2).otherwise(1)


def decoded(dep: Column, forms: Column) -> Column:
    """The names of a spelling, of the sum of their forms."""
    dashes = F.replace(dep, F.lit("_"), F.lit("-"))
    return (F.when(forms == 3, F.array(dep, dashes)).when(forms == 2, F.array(dashes))
            .otherwise(F.array(dep)))


def exploded(df: DataFrame, names: Column, key: str = "repo") -> DataFrame:
    """Distinct ``(key, dep, is_dev)``. Names shuffle by project and name together, so one
    project with very many manifests still spreads; a name with dashes and the same with
    underscores are one row until they are distinct."""
    def lists(n):
        return F.array(*[F.struct(n[name].alias("deps"), F.lit(name == "dev").alias("is_dev"))
                         for name in ("prod", "dev")])

    dep, form = coded(F.col("dep"))
    found = (df.select(key, F.inline(bound(names, lists)))
             .select(key, F.explode("deps").alias("dep"), "is_dev")
             .select(key, dep.alias("dep"), "is_dev", form.alias("form"))
             .groupBy(key, "dep", "is_dev").agg(F.bit_or("form").alias("forms")))
    return found.select(key, F.explode(decoded(F.col("dep"), F.col("forms"))).alias("dep"), "is_dev")


def extract(files: DataFrame, kind: str, key: str = "repo", content: str = "content") -> DataFrame:
    """Names of one kind of manifest."""
    return exploded(files, EXTRACTORS[kind](F.col(content)), key)


def extract_all(files: DataFrame, key: str = "repo") -> DataFrame:
    """Union of all extractors over one scan of ``key, path, content``."""
    def names(kind):
        return F.coalesce(*[F.when(kind == k, f(F.col("content"))) for k, f in EXTRACTORS.items()])

    # No filter on the kind: it would be pushed below the path and name it at each mention.
    return exploded(files, bound(manifest_kind(F.col("path")), names), key)


def lock_packages(content: Column) -> dict[str, Column]:
    """Package entries of a lock file, and those besides the project itself."""
    n = F.regexp_count(content, F.lit(r"\[\[package\]\]"))
    return {
        "cargo_lock_total_packages": n,
        "cargo_lock_external_estimate": F.greatest(n - 1, F.lit(0)),
        "cargo_lock_found": F.lit(True),
    }


def checksum_modules(files: DataFrame, key: str = "repo", content: str = "content") -> DataFrame:
    """Distinct modules per checksum file: first token of each line of two or more."""
    lines = files.select(key, F.explode(F.split(content, "\n")).alias("line"))
    tokens = (lines.filter(~F.startswith("line", F.lit("//")))
              .select(key, F.split(trim_all(F.col("line")), r"\s+").alias("t"))
              .filter(F.size("t") >= 2))
    return (tokens.select(key, F.get("t", F.lit(0)).alias("module")).distinct()
            .groupBy(key).agg(F.count(F.lit(1)).alias("go_sum_unique_modules")))


def folded(content: Column, start: dict[str, Column], step) -> Column:
    """Run a small state machine down the trimmed lines of a text."""
    lines = F.transform(F.split(content, "\n"), trim_all)
    state = F.struct(*[v.alias(k) for k, v in start.items()])
    return F.aggregate(lines, state, lambda s, line: F.struct(
        *[v.alias(k) for k, v in step(s, line).items()]))


def toml_counts(content: Column) -> Column:
    """Entries below the plain section headers; here build dependencies count as dev."""
    def step(s, line):
        section = (F.when(line == "[dependencies]", 1)
                   .when(line.isin("[dev-dependencies]", "[build-dependencies]"), 2)
                   .when(F.startswith(line, F.lit("[")), 0).otherwise(s["section"]))
        entry = (F.contains(line, F.lit("=")) & ~F.startswith(line, F.lit("#"))
                 & ~F.startswith(line, F.lit("[")))
        return {"section": section,
                "prod": s["prod"] + (entry & (s["section"] == 1)).cast("int"),
                "dev": s["dev"] + (entry & (s["section"] == 2)).cast("int")}

    end = folded(content, {"section": F.lit(0), "prod": F.lit(0), "dev": F.lit(0)}, step)
    return bound(end, lambda e: numbers(e["prod"], e["dev"]))


def gomod_counts(content: Column) -> Column:
    def step(s, line):
        opens = F.startswith(line, F.lit("require ("))
        closes = (line == ")") & s["inside"]
        listed = s["inside"] & (line != "") & ~F.startswith(line, F.lit("//"))
        single = F.startswith(line, F.lit("require "))
        return {"inside": F.when(opens, True).when(closes, False).otherwise(s["inside"]),
                "n": s["n"] + (~opens & ~closes & (listed | single)).cast("int")}

    end = folded(content, {"inside": F.lit(False), "n": F.lit(0)}, step)
    return numbers(end["n"])


def count_lines(content: Column, keep) -> Column:
    return F.size(F.filter(F.transform(F.split(content, "\n"), trim_all), keep))


def pip_counts(content: Column) -> Column:
    """Every line that is not blank, comment or option, in any of the file types."""
    return numbers(count_lines(content, lambda x: (x != "") & ~F.substring(x, 1, 1).isin("#", "-")))


def gradle_counts(content: Column) -> Column:
    def listed(line):
        hit = F.lit(False)
        for word in fixed.GRADLE_WORDS:
            hit = hit | F.contains(line, F.lit(word))
        return hit

    return numbers(count_lines(content, listed))


def npm_counts(content: Column) -> Column:
    """Entries of a package file; 0 where it is no JSON."""
    def size(parsed, field):
        return F.greatest(F.coalesce(F.size(F.map_keys(parsed[field])), F.lit(0)), F.lit(0))

    return bound(F.from_json(content, NPM_SCHEMA), lambda p: numbers(
        size(p, "dependencies"), size(p, "devDependencies") + size(p, "peerDependencies")))


def counted(kind: Column, content: Column) -> Column:
    """Cheap production and dev counts per manifest type, as a struct; other types count 0."""
    depends = F.regexp_count(content, F.lit("build-depends:"))
    haskell = F.when(depends > 0, depends).otherwise(F.regexp_count(content, F.lit(LIST_ENTRY)))
    counters = {
        "npm": npm_counts(content),
        "cargo": toml_counts(content),
        "go": gomod_counts(content),
        "pip": pip_counts(content),
        "maven": numbers(F.regexp_count(content, F.lit("<dependency>"))),
        "gradle": gradle_counts(content),
        "elixir": numbers(F.regexp_count(content, F.lit(ELIXIR_ENTRY))),
        "haskell": numbers(haskell),
    }
    return F.coalesce(*[F.when(kind == n, v) for n, v in counters.items()], numbers(F.lit(0)))


def manifest_counts(kind: Column, content: Column) -> tuple[Column, Column]:
    """The two counts as columns of their own."""
    found = counted(kind, content)
    return F.coalesce(found["prod"], F.lit(0)), F.coalesce(found["dev"], F.lit(0))


def manifest_rollup(files: DataFrame, key: str = "repo") -> DataFrame:
    """Per project: counts summed, manifest names in listing order, distinct ecosystems.

    Names and ecosystems come from a closed list, so the collected sets stay small; the
    sets are built from distinct pairs, combined ahead of the shuffle.
    """
    order = {n: i for i, n in enumerate(fixed.MANIFEST_KINDS)}
    known = files.withColumn("kind", lookup(F.col("name"), fixed.MANIFEST_KINDS, None)) \
        .filter("kind IS NOT NULL")
    per_name = known.select(key, "name", "kind", F.inline(F.array(counted(F.col("kind"), F.col("content"))))) \
        .groupBy(key, "name", "kind").agg(F.sum("prod").alias("p"), F.sum("dev").alias("d"))
    rank = lookup(F.col("name"), order, None)
    listed = F.array_sort(F.collect_set(F.struct(rank.alias("r"), F.col("name").alias("n"))))
    kinds = F.array_sort(F.collect_set("kind"))
    return per_name.groupBy(key).agg(
        F.sum("p").alias("dependency_count"), F.sum("d").alias("dev_dependency_count"),
        F.array_join(listed["n"], ",").alias("dep_files_found"),
        F.array_join(kinds, ",").alias("dep_ecosystems"),
        F.size(kinds).alias("dep_ecosystem_count"))


def match_declared(deps: DataFrame, names: DataFrame) -> DataFrame:
    """Which declared dependencies a project's manifests name.

    ``deps`` holds ``repo, dep, terms``, ``names`` holds ``repo, dep, is_dev``. A match is
    a slug inside a manifest name, or a term equal to a name in normal spelling. The former
    looks for each slug where its rarest four characters are, so a project whose slugs share
    an owner does not square; the latter joins on project and text. Adds ``in_prod`` and
    ``in_dev``.
    """
    slugs = deps.select("repo", F.col("dep").alias("slug"), F.lower("dep").alias("text"))
    lowered = cut_lineage(names.select("repo", F.lower("dep").alias("name"), "is_dev").distinct())
    inside = (contained(lowered, slugs, ["repo"], "name", "text")
              .join(lowered, ["repo", "name"]).join(slugs, ["repo", "text"]))
    terms = deps.select("repo", F.col("dep").alias("slug"),
                        F.explode("terms").alias("term")) \
        .select("repo", "slug", normalised(F.col("term")).alias("text")).distinct()
    plain = lowered.select("repo", "is_dev", normalised(F.col("name")).alias("text")).distinct()
    equal = plain.join(terms, ["repo", "text"])
    hits = inside.select("repo", "slug", "is_dev").unionByName(
        equal.select("repo", "slug", "is_dev"))
    found = hits.groupBy("repo", "slug").agg(
        F.bool_or(~F.col("is_dev")).alias("in_prod"), F.bool_or("is_dev").alias("in_dev"))
    return (deps.join(found.withColumnRenamed("slug", "dep"), ["repo", "dep"], "left")
            .fillna(False, ["in_prod", "in_dev"]))


def with_bonus(matched: DataFrame) -> DataFrame:
    """Bonus and dev-only flag: production beats development."""
    prod, dev = F.col("in_prod"), F.col("in_dev")
    return (matched
            .withColumn("manifest_match", prod | dev)
            .withColumn("dev_only", dev & ~prod)
            .withColumn("bonus", F.when(prod, fixed.MANIFEST_BONUS)
                        .when(dev, fixed.DEV_BONUS).otherwise(0.0)))
