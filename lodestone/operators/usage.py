"""How heavily source code uses its declared dependencies.

A text is cut, in the stage that reads it, into the pieces that usage patterns can match
(``lexers``). Pieces and search terms meet through the grams they share, and the patterns run on
the pieces. No text crosses an exchange and no list of dependencies is broadcast, at any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..functions.numeric import total
from ..functions.text import search_terms
from ..session import cut_lineage
from .containment import contained
from .joins import one_row_per_key, row_hash, skewed_join
from .lexers import NAME, names_in, token_index
from .manifests import match_declared, with_bonus
from .ranking import first_per_group

# Usage patterns per language. {t} is the search term, {p} the package name.
USAGE_PATTERNS = {
    "rust": {
        "imports": [r"\buse\s+{t}\s*(::|\s*;|\s*\{)", r"\bextern\s+crate\s+{t}\b"],
        "calls": [r"\b{t}::\w+\s*[(\[]?", r"#\[(?:derive\([^)]*\b{t}\b|{t}\b)"],
    },
    "go": {
        "imports": [r'import\s+"[^"]*{t}[^"]*"', r'"[^"]*{t}[^"]*"\s*\n'],
        "aliases": [r'\w+\s+"[^"]*{t}[^"]*"'],
        "calls": [r"\b{p}\.\w+\s*\("],
    },
    "python": {
        "imports": [r"^import\s+{t}\b", r"^from\s+{t}[\s.]"],
        "aliases": [r"^import\s+{t}\s+as\s+\w+"],
        "calls": [r"\b{t}\.\w+\s*[(\[]"],
    },
    "javascript": {
        "imports": [r"""from\s+['"][\w@/.-]*{t}[\w@/.-]*['"]""",
                    r"""require\s*\(\s*['"][\w@/.-]*{t}[\w@/.-]*['"]\s*\)"""],
        "aliases": [r"""import\s+\*\s+as\s+\w+\s+from\s+['"][\w@/.-]*{t}"""],
        "calls": [r"\b{p}\.\w+\s*[(\[]"],
    },
    "java": {
        "imports": [r"^import\s+[\w.]*{t}\b"],
        "calls": [r"\b{t}[\.\(]"],
    },
    "csharp": {
        "imports": [r"^using\s+[\w.]*{t}\b"],
        "calls": [r"\b{t}\.\w+\s*[(\[]"],
    },
    "ruby": {
        "imports": [r"""require\s+['"][\w/-]*{t}"""],
        "calls": [r"\b{t}[\.:]\w+"],
    },
    "nim": {
        "imports": [r"^import\s+[\w/]*{t}\b"],
        "calls": [r"\b{t}\.\w+"],
    },
    "other": {
        "imports": [r"""["\'`][\w/.-]*{t}[\w/.-]*["\'`]"""],
        "calls": [r"\b{t}[\.:]\w+"],
    },
}

# Patterns that bind an import to a name.
ALIAS_PATTERNS = {
    "python": [r"^import\s+{t}\s+as\s+(\w+)",
               r"^from\s+{t}[\s.]\s*import\s+\w+\s+as\s+(\w+)"],
    "javascript": [r"""import\s+\*\s+as\s+(\w+)\s+from\s+['"][\w@/.-]*{t}""",
                   r"""(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*['"][\w@/.-]*{t}""",
                   r"""import\s+(\w+)\s+from\s+['"][\w@/.-]*{t}[\w@/.-]*['"]"""],
}
NOT_ALIASES = ["type", "interface", "abstract"]
SAME_FAMILY = {"typescript": "javascript"}
UNGATED = ["python", "javascript", "typescript"]

COUNTS = ("imports", "aliases", "calls")
FAMILIES = {f: [f] + [k for k, v in SAME_FAMILY.items() if v == f] for f in USAGE_PATTERNS if f != "other"}

BY_NAME = [f for f, spec in USAGE_PATTERNS.items() if "{p}" in spec["calls"][0]]


def quoted(term: Column) -> Column:
    """Term as a literal inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def package_name(term: Column, family: str) -> Column:
    name = F.replace(F.substring_index(term, "/", -1), F.lit("-"), F.lit(""))
    return F.replace(name, F.lit("@"), F.lit("")) if family == "javascript" else name


def filled(pattern: str, term: Column, family: str, unicode: bool) -> Column:
    """Pattern column for one term; null where a package name is too short to count."""
    hole = "{t}" if "{t}" in pattern else "{p}"
    name = term if hole == "{t}" else package_name(term, family)
    flags = F.lit("(?Udm)" if unicode else "(?dm)")
    pieces = [F.lit(p) for p in pattern.split(hole)]
    out = [flags, pieces[0]]
    for piece in pieces[1:]:
        out += [quoted(name), piece]
    made = F.concat(*out)
    return made if hole == "{t}" else F.when(F.length(name) >= 3, made)


def matches(content: Column, pattern: Column) -> Column:
    return F.coalesce(F.regexp_count(content, pattern), F.lit(0))


def summed(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + value(x))


def aliases_of(content: Column, terms: Column, family: str, unicode: bool = True) -> Column:
    """Names that imports of the terms are bound to, repeats kept."""
    def found(term):
        kept = []
        for i, pattern in enumerate(ALIAS_PATTERNS[family]):
            names = F.regexp_extract_all(content, filled(pattern, term, family, unicode), F.lit(1))
            if family == "javascript" and i == 2:
                names = F.filter(names, lambda n: ~n.isin(NOT_ALIASES))
            kept.append(names)
        return F.concat(*kept)

    return F.flatten(F.transform(terms, found))


def alias_calls(content: Column, aliases: Column, unicode: bool = True) -> Column:
    """Member accesses on the aliases, each alias counted as often as it is listed."""
    flags = F.lit(r"(?Ud)\b" if unicode else r"(?d)\b")
    long_enough = F.filter(aliases, lambda a: F.length(a) >= 2)
    return summed(long_enough, lambda a: matches(
        content, F.concat(flags, quoted(a), F.lit(r"\.\w+"))))


def usage_in_text(content: Column, terms: Column, language: Column, unicode: bool = True) -> Column:
    """Struct of import, alias and call counts, summed over the terms.

    Patterns may overlap and then count twice, which is intended.
    """
    def family_counts(family):
        spec = USAGE_PATTERNS[family]

        def measure(name):
            patterns = spec.get(name, [])
            if not patterns:
                return F.lit(0)
            return summed(terms, lambda t: total(
                [matches(content, filled(p, t, family, unicode)) for p in patterns]))

        counts = {name: measure(name) for name in COUNTS}
        if family in ALIAS_PATTERNS:
            bound = aliases_of(content, terms, family, unicode)
            counts["calls"] = counts["calls"] + alias_calls(content, bound, unicode)
        return F.struct(*[counts[n].alias(n) for n in COUNTS])

    chosen = None
    for family in USAGE_PATTERNS:
        if family == "other":
            continue
        here = language.isin([family] + [k for k, v in SAME_FAMILY.items() if v == family])
        value = family_counts(family)
        chosen = F.when(here, value) if chosen is None else chosen.when(here, value)
    return chosen.otherwise(family_counts("other"))


def with_search_terms(deps: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds ``terms`` to ``dep, language``: those listed for a known slug (``slug`` in lower
    case, ``terms``; 2 characters at least), else those made from the name."""
    made = search_terms(F.col("dep"), F.col("language"))
    if overrides is None:
        return deps.withColumn("terms", made)
    listed = one_row_per_key(overrides.select(
        F.col("slug").alias("_slug"), F.filter("terms", lambda t: F.length(t) >= 2)
        .alias("_listed")), "_slug")
    return (skewed_join(deps.withColumn("_slug", F.lower("dep")), listed, "_slug", row_hash(deps), "left")
            .withColumn("terms", F.coalesce("_listed", made)).drop("_slug", "_listed"))


def may_occur(lowered: Column, terms: Column, language: Column) -> Column:
    """Cheap test ahead of the patterns: some term occurs, case aside. Python, JavaScript
    and TypeScript pass untested."""
    return language.isin(UNGATED) | F.exists(
        terms, lambda t: F.contains(lowered, F.lower(t)))


def file_score(imports: Column, aliases: Column, calls: Column, weight: Column,
               dev_only: Column) -> Column:
    """Log-scaled weight of one file; calls count up to 50."""
    raw = (imports * fixed.IMPORT_W + aliases * fixed.ALIAS_W
           + F.least(calls, F.lit(fixed.CALL_CAP)) * fixed.CALL_W)
    score = weight * F.log1p(raw)
    return F.when(dev_only, score * fixed.DEV_FACTOR).otherwise(score)


def source_files(files: DataFrame) -> DataFrame:
    """Paths that are source code outside skipped folders, with language and scan order."""
    path = F.col("path")
    return (files.withColumn("language", paths.file_language(path))
            .filter(F.col("language").isNotNull() & ~paths.in_skipped_dir(path))
            .withColumn("rank", paths.bucket_rank(path)))


def file_counts(files: DataFrame, cap: int = fixed.FILE_CAP) -> DataFrame:
    """Files scanned and skipped per project."""
    n = F.count(F.lit(1))
    return source_files(files).groupBy("repo").agg(
        F.least(n, F.lit(cap)).alias("file_count"),
        F.greatest(n - cap, F.lit(0)).alias("skipped"))


def capped_files(files: DataFrame, cap: int = fixed.FILE_CAP) -> DataFrame:
    """At most ``cap`` files per project, core ones first, tests last. Metadata only."""
    meta = source_files(files.select("repo", "path"))
    return first_per_group(meta, ["repo"], [F.col("rank"), F.col("path")], cap, F.col("path"))


def family_of(language: Column) -> Column:
    """Family whose patterns a language uses."""
    known = None
    for family, languages in FAMILIES.items():
        here = language.isin(languages)
        known = F.when(here, family) if known is None else known.when(here, family)
    return known.otherwise("other")


def readable(files: DataFrame) -> DataFrame:
    """Source files that are not blank."""
    return source_files(files).filter(F.col("content").rlike(r"(?U)\S"))


def term_rows(deps: DataFrame) -> DataFrame:
    """``repo, dep, term, times``: terms that are names, and how often a dependency lists them."""
    return (deps.select("repo", "dep", F.explode("terms").alias("term"))
            .filter(F.col("term").rlike(rf"(?U)\A{NAME}+\z"))
            .groupBy("repo", "dep", "term").agg(F.count(F.lit(1)).alias("times")))


def term_hits(files: DataFrame, deps: DataFrame) -> DataFrame:
    """``repo, path, dep``: dependencies of which some term occurs in a file, case aside.

    A term is a name, so it lies inside one of the file's names: those cross exchanges, the text
    does not.
    """
    names = cut_lineage(names_in(files))
    # the different names are counted once: for the search, and for the join with the files
    counts = cut_lineage(names.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("_n")))
    terms = cut_lineage(term_rows(deps).select("repo", "dep", F.lower("term").alias("term")))
    met = contained(counts, terms, ["repo"], "name", "term", different=True).join(terms, ["repo", "term"]).select(
        F.struct("repo", "name").alias("_at"), "dep").distinct()
    return skewed_join(names.select(F.struct("repo", "name").alias("_at"), "path"), cut_lineage(met), "_at", F.col("path"),
                       rows_of=counts.select(F.struct("repo", "name").alias("_at"), "_n")).select(
        "_at.repo", "path", "dep").distinct()


def candidates(files: DataFrame, deps: DataFrame) -> DataFrame:
    """``repo, path, language, dep, terms``: every scanned file beside each dependency that may
    occur in it. Python, JavaScript and TypeScript files take all of their project's; others
    those of which a term occurs, case aside. Texts stay in the scan."""
    read = readable(files)
    all_of = F.col("language").isin(UNGATED)
    free = skewed_join(read.filter(all_of).select("repo", "path", "language"), deps.select("repo", "dep", "terms"),
                       "repo", F.col("path"), counted=source_files(files.select("repo", "path")).filter(all_of))
    gated = read.filter(~all_of)
    met = term_hits(gated, deps).join(gated.select("repo", "path", "language"), ["repo", "path"]).join(
        deps.select("repo", "dep", "terms"), ["repo", "dep"])
    return free.unionByName(met.select(*free.columns))


def matched(index: DataFrame, deps: DataFrame) -> DataFrame:
    """Pieces of the index beside each term that may match there: adds ``dep, term, times``.

    A piece meets the term itself, or the package name made from it where the family's calls are
    made on that.
    """
    terms = term_rows(deps)
    named = [terms.withColumn("role", F.lit("")).withColumn("phrase", F.col("term"))]
    named += [terms.withColumn("role", F.lit(f)).withColumn("phrase", package_name(F.col("term"), f))
              .filter(F.length("phrase") >= 3) for f in BY_NAME]
    phrases = cut_lineage(reduce(DataFrame.union, named))
    pairs = contained(index, phrases, ["repo"], "piece", "phrase").join(phrases, ["repo", "phrase"]).select(
        F.struct("repo", "piece", "role").alias("_at"), "dep", "term", "times")
    by_name = (F.col("measure") == "calls") & F.col("family").isin(BY_NAME)
    asked = index.withColumn("family", family_of(F.col("language"))).withColumn(
        "_at", F.struct("repo", "piece", F.when(by_name, F.col("family")).otherwise("").alias("role")))
    return skewed_join(asked, cut_lineage(pairs), "_at", F.col("path")).drop("_at")


def pattern_counts(pairs: DataFrame, unicode: bool) -> DataFrame:
    """``pairs`` with ``hits``: how often the piece's own pattern matches in it. ``inline`` keeps
    what is asked of the hits above them, so that patterns run once a pair."""
    hits = None
    for family, spec in USAGE_PATTERNS.items():
        for measure, patterns in spec.items():
            for i, pattern in enumerate(patterns):
                here = (F.col("family") == family) & (F.col("measure") == measure) & (F.col("pattern") == i)
                count = matches(F.col("piece"), filled(pattern, F.col("term"), family, unicode))
                if family == "go" and "\"" in pattern:
                    count = F.lit(1)  # the term is between the quotes, which is all that is asked
                hits = F.when(here, count) if hits is None else hits.when(here, count)
    found = pairs.select("*", F.inline(F.array(F.struct(F.coalesce(hits, F.lit(0)).alias("_hits")))))
    return found.withColumn("hits", F.when(F.col("way") == "each", F.col("_hits")).otherwise(F.least("_hits", F.lit(1)))).drop("_hits")


def every_second(places: DataFrame, by: list[str]) -> DataFrame:
    """Of neighbouring gaps in a file every second one counts, as a match takes both quotes."""
    order = Window.partitionBy(*by).orderBy("number")
    runs = places.select(*by, "number", (F.col("number") - F.row_number().over(order)).alias("_run"))
    return runs.groupBy(*by, "_run").agg(F.ceil(F.count(F.lit(1)) / F.lit(2)).alias("hits")).drop("_run")


def bound_names(pairs: DataFrame, unicode: bool) -> DataFrame:
    """``repo, path, dep, alias, times``: names that imports of a dependency are bound to, and how
    often."""
    names = None
    for family, patterns in ALIAS_PATTERNS.items():
        for i, pattern in enumerate(patterns):
            found = F.regexp_extract_all("piece", filled(pattern, F.col("term"), family, unicode), F.lit(1))
            if family == "javascript" and i == 2:
                found = F.filter(found, lambda n: ~n.isin(NOT_ALIASES))
            here = (F.col("family") == family) & (F.col("pattern") == i)
            names = F.when(here, found) if names is None else names.when(here, found)
    return (pairs.filter("measure = 'binds'").select("repo", "path", "dep", "n", "times", F.explode(names).alias("alias"))
            .groupBy("repo", "path", "dep", "alias").agg(F.sum(F.col("n") * F.col("times")).alias("times")))


def calls_on_aliases(index: DataFrame, bound: DataFrame, unicode: bool) -> DataFrame:
    """``repo, path, dep, n``: member accesses on bound names of two characters at least, each
    name counted as often as it is bound; 0 where there is none."""
    flags = "(?Ud)" if unicode else "(?d)"
    words = F.regexp_extract_all("piece", F.lit(flags + r"\b(\w++)(?=\.\w)"), F.lit(1))
    uses = index.filter(F.col("language").isin(UNGATED) & (F.col("measure") == "calls")).select(
        "repo", "path", "piece", "n", F.explode(F.array_distinct(words)).alias("alias"))
    hits = matches(F.col("piece"), F.concat(F.lit(flags + r"\b"), quoted(F.col("alias")), F.lit(r"\.\w+")))
    used = uses.groupBy("repo", "path", "alias").agg(F.sum(F.col("n") * hits).alias("n"))
    each = bound.join(used, ["repo", "path", "alias"], "left")
    long_enough = F.when(F.length("alias") >= 2, F.col("times") * F.coalesce("n", F.lit(0))).otherwise(0)
    return each.groupBy("repo", "path", "dep").agg(F.sum(long_enough).cast("bigint").alias("n"))


def alias_use(files: DataFrame, deps: DataFrame, unicode: bool = True) -> DataFrame:
    """``repo, path, dep, n``: member accesses on names that a file's imports of a dependency are
    bound to, for each pair that has such a name."""
    kept = readable(files).filter(F.col("language").isin(UNGATED))
    index = cut_lineage(token_index(kept, FAMILIES, unicode))
    return calls_on_aliases(index, bound_names(matched(index, deps), unicode), unicode)


def plain_of(hits: DataFrame) -> DataFrame:
    return hits.select("repo", "path", "dep", "measure", (F.col("hits") * F.col("n") * F.col("times")).alias("n"))


def usage_per_file(files: DataFrame, deps: DataFrame, unicode: bool = True) -> DataFrame:
    """``repo, path, dep, imports, aliases, calls`` where any is above 0.

    ``deps`` has one row a project and dependency. Terms are names (word characters and
    ``@ / . : + ~ -``); others find nothing. Calls on a Go package's name count only where a term
    of the dependency occurs in the file. The written index holds pieces and counts, not texts.
    """
    key = ["repo", "path", "dep"]
    index = cut_lineage(token_index(readable(files), FAMILIES, unicode))
    pairs = cut_lineage(matched(index, deps))
    hits = cut_lineage(pattern_counts(pairs.filter("measure <> 'binds'"), unicode).filter("hits > 0").drop("piece"))
    place = [*key, "term", "times", "measure", "pattern"]
    grouped = hits.filter("way = 'group'").select(*place, "number").distinct().select(*key, "measure", F.col("times").alias("n"))
    between = every_second(hits.filter("way = 'gaps'").select(*place, "number").distinct(), place).select(
        *key, "measure", (F.col("hits") * F.col("times")).alias("n"))
    aliased = calls_on_aliases(index, bound_names(pairs, unicode), unicode).select(*key, F.lit("calls").alias("measure"), "n")
    go = F.col("language") == "go"
    gate = term_hits(readable(files).filter(go), deps)
    named = (F.col("family") == "go") & (F.col("measure") == "calls")
    go_calls = plain_of(hits.filter(named)).join(gate, key, "left_semi")
    plain = plain_of(hits.filter("way in ('each', 'once')").filter(~named))
    every = plain.union(go_calls).union(grouped).union(between).union(aliased)
    sums = [F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).cast("int").alias(m) for m in COUNTS]
    return every.groupBy(*key).agg(*sums).filter(F.col("imports") + F.col("aliases") + F.col("calls") > 0)


def usage_scores(files: DataFrame, deps: DataFrame, manifest_names: DataFrame,
                 unicode: bool = True, listing: DataFrame | None = None) -> DataFrame:
    """One row per declared dependency: how it is declared and how it is used, in all files.

    Manifest bonus plus file scores; a dependency called more than 5 times and by tests
    for more than 80% of that loses half. Unused dependencies keep a row. ``listing`` has
    ``repo, path`` of files that may not have been read: Spark's file sources pass over files of
    zero bytes, but they count in ``file_count`` if the file tree (``project_row.listed_files``)
    names them.
    """
    declared = with_bonus(match_declared(deps, manifest_names))
    path = F.col("path")
    per_file = usage_per_file(files, deps, unicode)
    plain = file_score(F.col("imports"), F.col("aliases"), F.col("calls"),
                       paths.weight(path), F.lit(False))
    tests = paths.bucket(path) == "test"
    rolled = per_file.select(
        "repo", "dep", "imports", "calls", plain.alias("score"),
        F.when(tests, F.col("calls")).otherwise(0).alias("test_calls")
    ).groupBy("repo", "dep").agg(
        F.sum("score").alias("score"), F.sum("imports").alias("total_imports"),
        F.sum("calls").alias("total_calls"), F.sum("test_calls").alias("test_calls"))
    out = declared.join(rolled, ["repo", "dep"], "left")
    known = files.select("repo", "path")
    if listing is not None:
        known = known.union(listing.select("repo", "path")).distinct()
    scanned = source_files(known).groupBy("repo").agg(F.count(F.lit(1)).alias("file_count"))
    out = skewed_join(out, scanned, "repo", F.col("dep"), "left", counted=deps).fillna(
        0, ["score", "total_imports", "total_calls", "test_calls", "file_count"])
    used = F.when(F.col("dev_only"), F.col("score") * fixed.DEV_FACTOR).otherwise(F.col("score"))
    tested = ((F.col("total_calls") > fixed.TEST_MIN_CALLS)
              & (F.col("test_calls") / F.greatest(F.col("total_calls"), F.lit(1))
                 > fixed.TEST_SHARE))
    weighted = F.col("bonus") + used
    return out.select(
        "repo", F.col("dep").alias("dependency"),
        F.when(tested, weighted * fixed.TEST_FACTOR).otherwise(weighted).alias("weighted_score"),
        "manifest_match", (F.col("score") > 0).alias("source_match"),
        "total_imports", "total_calls", F.col("file_count").cast("bigint"))
