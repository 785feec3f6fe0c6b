"""What a file's path says about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numeric import lookup

LANGUAGE_BY_EXT = {ext: lang for lang, exts in fixed.EXTENSIONS.items() for ext in exts}


def parts(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def file_language(path: Column) -> Column:
    """Language by extension; null for other files."""
    name = F.substring_index(path, "/", -1)
    ext = F.lower(F.substring_index(name, ".", -1))
    known = lookup(ext, LANGUAGE_BY_EXT, None)
    return F.when(F.instr(name, ".") > 1, known)


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(parts(path), words(fixed.SKIP_DIRS))


def bucket(path: Column) -> Column:
    """``test``, ``core`` or ``normal`` by exact components, the file name included."""
    return (F.when(F.arrays_overlap(parts(path), words(fixed.TEST_WORDS)), "test")
            .when(F.arrays_overlap(parts(path), words(fixed.CORE_DIRS)), "core")
            .otherwise("normal"))


def bucket_rank(path: Column) -> Column:
    """Scan order: core, normal, test."""
    kind = bucket(path)
    return F.when(kind == "core", 0).when(kind == "normal", 1).otherwise(2)


def weight(path: Column) -> Column:
    """Weight by directory: the first component that decides wins.

    Here a test word counts anywhere inside a component, and the file name does not count:
    another rule than ``bucket``, on purpose.
    """
    folders = F.slice(parts(path), 1, F.size(parts(path)) - 1)
    tests = "|".join(fixed.TEST_WORDS)
    decided = F.array_compact(F.transform(
        folders,
        lambda p: F.when(p.rlike(tests), F.lit(fixed.TEST_WEIGHT))
        .when(p.isin(fixed.CORE_DIRS), F.lit(fixed.CORE_WEIGHT))))
    return F.coalesce(F.get(decided, F.lit(0)), F.lit(fixed.PLAIN_WEIGHT))
