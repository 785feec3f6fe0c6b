"""Columns from landed JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import share, whole_days

METADATA_SCHEMA = """
full_name string, description string, homepage string, language string,
stargazers_count bigint, subscribers_count bigint, forks_count bigint,
open_issues_count bigint, size bigint, default_branch string, fork boolean,
archived boolean, is_template boolean, has_wiki boolean, has_pages boolean,
has_discussions boolean, license struct<spdx_id: string>, created_at string,
updated_at string, pushed_at string, topics array<string>, network_count bigint,
parent struct<full_name: string>, source struct<full_name: string>
"""

# Output column, field of the payload, default.
METADATA_COLUMNS = [
    ("full_name", "full_name", ""),
    ("description", "description", ""),
    ("homepage", "homepage", ""),
    ("language", "language", ""),
    ("stars", "stargazers_count", 0),
    ("watchers", "subscribers_count", 0),
    ("forks_count", "forks_count", 0),
    ("open_issues", "open_issues_count", 0),
    ("size_kb", "size", 0),
    ("default_branch", "default_branch", "main"),
    ("is_fork", "fork", False),
    ("is_archived", "archived", False),
    ("is_template", "is_template", False),
    ("has_wiki", "has_wiki", False),
    ("has_pages", "has_pages", False),
    ("has_discussions", "has_discussions", False),
    ("license", "license.spdx_id", ""),
    ("created_at", "created_at", ""),
    ("updated_at", "updated_at", ""),
    ("pushed_at", "pushed_at", ""),
    ("topics", "topics", ""),
    ("network_count", "network_count", 0),
    ("parent_repo", "parent.full_name", ""),
    ("source_repo", "source.full_name", ""),
]


def metadata_columns(payload: str = "payload", full_name: Column | None = None) -> list[Column]:
    """The 24 metadata columns of a parsed payload struct, defaults filled in."""
    out = []
    for name, field, default in METADATA_COLUMNS:
        value = F.col(f"{payload}.{field}")
        if name == "topics":
            value = F.array_join(value, ",")
        if name == "full_name" and full_name is not None:
            value = F.coalesce(value, full_name)
        out.append(F.coalesce(value, F.lit(default)).alias(name))
    return out


def series_sum(series: Column) -> Column:
    return F.aggregate(F.coalesce(series, F.array().cast("array<double>")),
                       F.lit(0.0), lambda a, x: a + x)


def recent_mean(series: Column, last: int = 4) -> Column:
    """Mean of the last entries; 0 where there are fewer."""
    tail = F.slice(series, -last, last)
    return F.when(F.size(series) >= last, series_sum(tail) / last).otherwise(F.lit(0.0))


def link_total(header: Column, body_size: Column) -> Column:
    """Total from a paging header, else the length of the only page."""
    page = F.regexp_extract(F.coalesce(header, F.lit("")), r'page=(\d+)>; rel="last"', 1)
    return F.coalesce(F.nullif(page, F.lit("")).try_cast("bigint"), body_size.cast("bigint"))


def language_shares(languages: Column) -> dict[str, Column]:
    """Count, total and leading share of a language -> bytes map."""
    sizes = F.map_values(languages)
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    filled = F.coalesce(F.size(languages) > 0, F.lit(False))
    return {
        "languages_count": F.when(filled, F.size(languages)).otherwise(0),
        "primary_language_pct": F.when(
            filled, F.round(F.try_divide(F.array_max(sizes), total) * 100, 1)).otherwise(0.0),
        "total_code_bytes": F.when(filled, total).otherwise(F.lit(0).cast("bigint")),
        "languages_detail": F.when(filled, F.to_json(languages)).otherwise(""),
    }


def graph_counts(graph: Column) -> dict[str, Column]:
    """Direct and transitive dependencies of a resolved graph; node 0 is the package."""
    direct = F.size(F.filter(graph["edges"], lambda e: e["fromNode"] == 0))
    return {
        "direct": F.when(graph["edges"].isNotNull(), direct).otherwise(0),
        "transitive": F.when(graph["nodes"].isNotNull(),
                             F.greatest(F.size(graph["nodes"]) - 1, F.lit(0))).otherwise(0),
        "found": graph.isNotNull(),
    }


def list_length(items: Column) -> Column:
    return F.when(items.isNotNull(), F.size(items)).otherwise(0)


def release_columns(releases: Column) -> dict[str, Column]:
    return {
        "release_count": list_length(releases),
        "latest_release_date": F.coalesce(
            F.get(releases, F.lit(0))["published_at"], F.lit("")),
        "has_releases": list_length(releases) > 0,
    }


def community_columns(profile: Column) -> dict[str, Column]:
    out = {"health_percentage": F.coalesce(profile["health_percentage"], F.lit(0))}
    for name in ("code_of_conduct", "contributing", "issue_template", "pull_request_template"):
        out[f"has_{name}"] = F.coalesce(profile["files"][name].isNotNull(), F.lit(False))
    return out


def derived_ratios(as_of: str) -> dict[str, Column]:
    """Ratio features of a wide project row; no denominator is below 1."""
    def num(name):
        return F.coalesce(F.col(name), F.lit(0))

    def days_since(name):
        return F.coalesce(whole_days(F.col(name), F.lit(as_of)), F.lit(0))

    age = days_since("created_at")
    return {
        "age_days": age,
        "days_since_push": days_since("pushed_at"),
        "fork_to_star_ratio": share(num("forks_count"), num("stars"), 4),
        "deps_per_src_file": share(num("dependency_count"), num("src_file_count"), 4),
        "deps_per_1k_loc": share(num("dependency_count"), num("total_code_bytes") / 1000, 6),
        "src_to_total_file_ratio": share(num("src_file_count"), num("total_files"), 4),
        "commits_per_contributor": share(num("total_commits"), num("contributor_count"), 2),
        "stars_per_contributor": share(num("stars"), num("contributor_count"), 2),
        "code_bytes_per_dep": share(num("total_code_bytes"), num("dependency_count"), 2),
        "commits_per_age_day": share(num("total_commits"), age, 4),
    }
