"""Catalogue of checked queries: name -> (Spark query, SQL to check it by)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables

CATALOGUE: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = (fn, sql)
        return fn

    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = load()[name][0]
    return lambda spark, folder: fn(Tables(spark, folder))


def load() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    """Import every module of queries."""
    from . import (  # noqa: F401
        checks_features, checks_manifests, checks_relational, checks_rows, checks_scoring, checks_text,
        checks_usage,
    )
    return CATALOGUE
