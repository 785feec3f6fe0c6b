"""Arithmetic of the features."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ISO_STAMP = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
             r"(Z|[+-]\d{2}:?\d{2})?)?$")
SECONDS_PER_DAY = 86400


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound ``x``; null stays null, which ``greatest`` and ``least`` alone would lose."""
    y = x
    if high is not None:
        y = F.least(y, F.lit(high))
    if low is not None:
        y = F.greatest(y, F.lit(low))
    return F.when(x.isNotNull(), y)


def to_number(x: Column) -> Column:
    """Number, or 0 where there is none to read. NaN counts as none."""
    value = x.try_cast("double")
    return F.when(F.isnan(value), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def log_norm(x: Column, top: Column) -> Column:
    """``log1p(x) / log1p(top)``; null where ``top`` is 0."""
    return F.log1p(x) / F.nullif(F.log1p(top), F.lit(0.0))


def sqrt_norm(x: Column, top: Column) -> Column:
    """Square-root compression to 0..1."""
    return F.sqrt(x / (top + F.lit(1e-9)))


def epoch_seconds(text: Column) -> Column:
    """ISO-8601 text to seconds since 1970: ``T`` or blank, any offset, UTC where none is
    given. Null where the text is no such time.

    Read without a zone, so the session's zone plays no part.
    """
    flat = F.trim(text)
    wall = F.regexp_replace(flat, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    offset = F.regexp_extract(flat, r":\d{2}(?:\.\d+)?([+-]\d{2}):?\d{2}$", 1)
    minutes = F.regexp_extract(flat, r":\d{2}(?:\.\d+)?[+-]\d{2}:?(\d{2})$", 1)
    sign = F.when(F.startswith(offset, F.lit("-")), -60).otherwise(60)
    ahead = F.when(offset != "", offset.try_cast("int") * 3600
                   + minutes.try_cast("int") * sign).otherwise(0)
    return F.when(flat.rlike(ISO_STAMP), F.timestamp_diff("SECOND", start, wall) - ahead)


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole days between two texts of time, not calendar days."""
    return F.floor((epoch_seconds(end) - epoch_seconds(start)) / SECONDS_PER_DAY)


def age_years(created: Column, as_of: str) -> Column:
    """Age at ``as_of`` in years of 365.25 days, 0.1 at least; 1.0 where unreadable.

    The moment of reference is an argument, so a run can be repeated.
    """
    years = whole_days(created, F.lit(as_of)) / F.lit(365.25)
    above = years - F.lit(fixed.AGE_FLOOR)
    # Half of x + |x| is x where positive, else 0; unlike greatest() it keeps null, and the
    # parsed time is used in one unconditional place, so it is computed once.
    return F.coalesce((above + F.abs(above)) / 2 + F.lit(fixed.AGE_FLOOR),
                      F.lit(fixed.AGE_UNKNOWN))


def age_adjusted(count: Column, age: Column) -> Column:
    """Dependency count eased by age; the benefit ends at seven years."""
    return count / F.log1p(F.least(age, F.lit(fixed.AGE_CAP)))


def first_positive(sources: Sequence[Column], fallback: Column) -> Column:
    """First source above 0 — not the first that is present."""
    return F.coalesce(*[F.when(s > 0, s) for s in sources], fallback)


def ecosystem_factor(cargo: Column, go: Column, ecosystem: Column) -> Column:
    """Scale by which lock files exist, whichever source won the count."""
    return (F.when(cargo > 0, F.lit(fixed.CARGO_SCALE))
            .when(go > 0, F.lit(fixed.GO_SCALE))
            .when(F.contains(F.upper(ecosystem), F.lit("MAVEN")), F.lit(fixed.MAVEN_SCALE))
            .otherwise(F.lit(1.0)))


def soft_cap(x: Column, cap: Column, decay: float = fixed.CAP_DECAY,
             floor: float = fixed.SCORE_FLOOR) -> Column:
    """Above ``cap`` growth slows to ``decay``; never below ``floor``, no ceiling."""
    eased = F.when(x > cap, cap + (x - cap) * decay).otherwise(x)
    return F.greatest(eased, F.lit(floor))


def share(part: Column, whole: Column, digits: int) -> Column:
    """Ratio with a denominator of at least 1."""
    return F.round(part / F.greatest(whole, F.lit(1)), digits)


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def lookup(key: Column, table: dict, default) -> Column:
    """Small dictionary folded into the plan: no join, nothing to ship."""
    if not table:
        return F.lit(default)
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names
    it; inside conditions Spark would compute it anew at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def axis(start: float, step: float, count: int) -> list[float]:
    """Points of a grid axis by count, which no rounding can lengthen or shorten."""
    return [start + i * step for i in range(count)]


CODE_NORM_LOG = math.log1p(fixed.CODE_NORM)
