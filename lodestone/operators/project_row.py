"""One wide row per project from payloads as they were landed.

A payload is parsed once, into a variant, in the stage that reads it. Every column is a typed read
from that, and what is there but does not fit its type is kept for an audit. The texts end there:
what is shuffled are typed values, and of a kind of payload landed several times the newest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payloads, text
from ..functions.keys import owner_and_name
from ..session import cut_lineage
from .manifests import manifest_rollup
from .tree import tree_stats


# Kind of payload, field, its path and type. The metadata's come from their own table.
FIELDS = [("repo", name, f"$.{path}", "array<string>" if name == "topics" else
           "boolean" if default is False else "bigint" if default == 0 else "string")
          for name, path, default in payloads.METADATA_COLUMNS] + [
    ("participation", "all", "$.all", "array<double>"),
    ("participation", "owner", "$.owner", "array<double>"),
    ("languages", "languages", "$", "map<string, bigint>"),
    ("releases", "releases", "$", "array<struct<published_at: string>>"),
    ("commits", "commits", "$", "array<variant>"),
    ("contributors", "contributors", "$", "array<variant>"),
    ("branches", "branches", "$", "array<variant>"),
    ("tags", "tags", "$", "array<variant>"),
    ("community", "health_percentage", "$.health_percentage", "bigint"),
    ("tree", "items", "$.tree", "array<struct<path: string, type: string, size: bigint>>"),
]
COMMUNITY_FILES = ("code_of_conduct", "contributing", "issue_template", "pull_request_template")
COUNTED = ("commits", "contributors", "branches", "tags")
NO_TREE = {"total_files": 0, "total_dirs": 0, "tree_depth": 0, "readme_size": 0, "src_file_count": 0,
           "test_file_count": 0, "config_file_count": 0, "has_ci_cd": False, "has_dockerfile": False,
           "has_docs": False, "has_tests": False, "has_examples": False, "has_benchmarks": False}
NO_MANIFESTS = {"dependency_count": 0, "dev_dependency_count": 0, "dep_files_found": "",
                "dep_ecosystems": "", "dep_ecosystem_count": 0}


def there(value: Column) -> Column:
    """Is a value in the payload, other than JSON's null?"""
    return value.isNotNull() & ~F.is_variant_null(value)


def typed_payloads(landed: DataFrame) -> DataFrame:
    """Typed fields of ``repo_url, kind, payload, header, landed``, a row a payload.

    ``read`` has the fields of the payload's own kind, nulls for the others; ``misfits`` lists
    fields that are there but do not fit, with ``$`` for a payload that is no JSON. ``mark`` tells
    payloads landed at one time apart.
    """
    parsed = landed.select("repo_url", "kind", "header", "landed", F.xxhash64("payload").alias("mark"),
                           F.col("payload").isNotNull().alias("given"), F.try_parse_json("payload").alias("v"))
    fields, misfits = [], [F.when(F.col("given") & F.col("v").isNull(), F.struct(
        F.lit("$").alias("path"), F.lit("").alias("found")))]
    for kind, name, path, type_ in FIELDS:
        own = F.col("kind") == kind
        value, raw = F.try_variant_get("v", path, type_), F.try_variant_get("v", path, "variant")
        # The value first: where it fits, which is nearly everywhere, the raw one is never read.
        wrong = own & value.isNull() & there(raw)
        misfits.append(F.when(wrong, F.struct(F.lit(path).alias("path"), F.to_json(raw).alias("found"))))
        kept = F.size(value).cast("bigint") if name in COUNTED else F.array_sort(F.map_entries(value)) if name == "languages" else value
        fields.append(F.when(own & value.isNotNull() if name in COUNTED else own, kept).alias(name))
    for name in COMMUNITY_FILES:
        given = there(F.try_variant_get("v", f"$.files.{name}", "variant"))
        fields.append(F.when(F.col("kind") == "community", given).alias(f"has_{name}"))
    return parsed.select("repo_url", "kind", "header", "landed", "mark", F.struct(*fields).alias("read"),
                         F.array_compact(F.array(*misfits)).alias("misfits"))


def payload_audit(typed: DataFrame) -> DataFrame:
    """``repo_url, kind, landed, path, found``: fields that are there but do not fit their type,
    as they were found."""
    return typed.select("repo_url", "kind", "landed", F.inline("misfits"))


def listed_files(typed: DataFrame) -> DataFrame:
    """``repo, path`` of every file that a newest listed tree names, files of zero bytes among
    them. ``repo`` is the project's URL."""
    trees = typed.filter("read.items is not null")
    last = trees.groupBy("repo_url").agg(F.max(F.struct("landed", "mark")).alias("_last"))
    newest = trees.select("repo_url", F.struct("landed", "mark").alias("_last"), "read.items").join(last, ["repo_url", "_last"])
    items = newest.select(F.col("repo_url").alias("repo"), F.inline("items"))
    return items.filter("type = 'blob'").select("repo", "path").distinct()


def with_tree(typed: DataFrame) -> DataFrame:
    """Statistics of each listed file tree, beside its project and time; entries are counted in
    the stage that reads them."""
    items = typed.filter("read.items is not null").select(
        F.struct("repo_url", "landed", "mark").alias("place"), F.posexplode("read.items").alias("ord", "i"))
    return tree_stats(items.select("place", "ord", "i.path", "i.type", "i.size"), "place")


def project_rows(typed: DataFrame, as_of: str, manifests: DataFrame | None = None) -> DataFrame:
    """The wide row of every project whose metadata were landed, defaults where a payload is
    missing, unreadable or does not fit.

    ``typed`` comes from ``typed_payloads`` and is read twice, so pass a written table.
    ``manifests`` has ``repo_url, name, payload``: manifest files in base64, as they are served.
    Of several payloads of a kind the one landed last counts.
    """
    def newest(kind, *fields):
        return F.max(F.when(F.col("kind") == kind, F.struct(
            "landed", "mark", *[F.col(f).alias(f.split(".")[-1]) for f in fields]))).alias(f"_{kind}")

    own: dict[str, list[str]] = {}
    for kind, name, *_ in FIELDS:
        own.setdefault(kind, []).append(f"read.{name}")
    own["community"] += [f"read.has_{n}" for n in COMMUNITY_FILES]
    own["commits"].append("header")
    del own["tree"]
    trees = with_tree(typed).select(F.col("place.repo_url").alias("repo_url"), F.struct(
        "place.landed", "place.mark", *NO_TREE).alias("_t")).groupBy("repo_url").agg(F.max("_t").alias("_tree"))
    rows = typed.groupBy("repo_url").agg(*[newest(k, *f) for k, f in own.items()]).filter(
        "_repo is not null").join(trees, "repo_url", "left")
    if manifests is None:
        rows = rows.withColumns({n: F.lit(v) for n, v in NO_MANIFESTS.items()})
    else:
        files = manifests.select("repo_url", "name", text.decode_base64(F.col("payload")).alias("content"))
        rows = rows.join(manifest_rollup(files, "repo_url"), "repo_url", "left").fillna(NO_MANIFESTS)
    owner, name = owner_and_name(F.col("repo_url"))
    out = {"owner": owner, "repo_name": name}
    for column, path, default in payloads.METADATA_COLUMNS:
        value = F.col(f"_repo.{column}")
        value = F.array_join(value, ",") if column == "topics" else value
        out[column] = F.coalesce(value, F.concat(owner, F.lit("/"), name) if column == "full_name" else F.lit(default))
    year = F.col("_participation.all")
    languages = F.map_from_entries("_languages.languages")
    profile = F.struct(
        F.col("_community.health_percentage").alias("health_percentage"),
        F.struct(*[F.when(F.col(f"_community.has_{n}"), True).alias(n) for n in COMMUNITY_FILES]).alias("files"))
    out |= {
        "contributor_count": F.coalesce("_contributors.contributors", F.lit(0)),
        "total_commits": F.coalesce(payloads.link_total(F.col("_commits.header"), F.col("_commits.commits")), F.lit(0)),
        "commits_last_year": payloads.series_sum(year).cast("bigint"),
        "owner_commits_year": payloads.series_sum(F.col("_participation.owner")).cast("bigint"),
        "recent_weekly_commit_avg": F.round(F.coalesce(payloads.recent_mean(year), F.lit(0.0)), 2),
        **payloads.language_shares(languages), **payloads.release_columns(F.col("_releases.releases")),
        "branch_count": F.coalesce("_branches.branches", F.lit(0)), "tag_count": F.coalesce("_tags.tags", F.lit(0)),
        **{n: F.col(n) for n in NO_MANIFESTS},
        **{n: F.coalesce(F.col(f"_tree.{n}"), F.lit(d)) for n, d in NO_TREE.items()},
        **payloads.community_columns(profile),
    }
    wide = rows.select("repo_url", *[c.alias(n) for n, c in out.items()])
    signals = text.description_signals(F.col("description"), F.col("topics"))
    wide = wide.withColumns(signals)
    return wide.withColumns(payloads.derived_ratios(as_of))


def collected(landed: DataFrame, as_of: str, manifests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(wide rows, audit) of landed payloads, which are parsed once for both."""
    typed = cut_lineage(typed_payloads(landed))
    return project_rows(typed, as_of, manifests), payload_audit(typed)
