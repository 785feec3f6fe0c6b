"""Text signals."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .keys import trim_all
from .numeric import bound, lookup, total


FEW_PHRASES = 40


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def trie(phrases: Sequence[str]) -> str:
    """Pattern that matches the longest of the phrases that begin at a place, letter by letter:
    phrases with the same beginning share it."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node):
        branches = [re.escape(c) + written(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return written(root)


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    """The different phrases that begin somewhere in the text, the longest at each place: all of
    them are looked for in one pass. A few are looked for one by one, which takes less time than
    one pattern for them. ``mentions`` reads the result."""
    kept = [p for p in phrases if p]
    if not kept:
        return F.array().cast("array<string>")
    if len(kept) <= FEW_PHRASES:
        listed = F.array(*[F.lit(p) for p in kept])
        return bound(text, lambda t: F.filter(listed, lambda p: F.contains(t, p)))
    first = "".join(sorted({re.escape(p[0]) for p in kept}))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=[{first}])(?=({trie(kept)}))"), F.lit(1)))


def mentions(found: Column, wanted: Sequence[str], phrases: Sequence[str]) -> Column:
    """Is any of the ``wanted`` among ``phrases_in``? A phrase is also there where a longer one of
    ``phrases`` begins with it."""
    longer = sorted({p for p in phrases if any(p.startswith(w) for w in wanted)})
    if not longer:
        return F.lit(False)
    return F.arrays_overlap(found, F.array(*[F.lit(p) for p in longer]))


def contains_one(text: Column, phrases: Sequence[str]) -> Column:
    """Is any of the phrases in the text? Looked for one by one, up to the first that is."""
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases if p], F.lit(False))


def counted(found: Column, wanted: Sequence[str], phrases: Sequence[str]) -> Column:
    return total([mentions(found, [p], phrases).cast("int") for p in wanted] or [F.lit(0)])


def hits(text: Column, *lists: Sequence[str]) -> list[Column]:
    """How many phrases of each list are found in text that is lower-cased already, each counted
    once. One pass over the text for all lists."""
    every = sorted({p for phrases in lists for p in phrases})

    counts = bound(phrases_in(text, every), lambda found: F.array(*[counted(found, p, every) for p in lists]))
    return [F.get(counts, F.lit(i)) for i in range(len(lists))]


def keyword_hits(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur, each counted once, case aside."""
    return hits(lowered(text), phrases)[0]


def readme_signal(text: Column, high: Sequence[str] = fixed.README_HIGH,
                  low: Sequence[str] = fixed.README_LOW) -> Column:
    """Depth phrases minus packaging phrases, bounded."""
    every = sorted({*high, *low})

    balance = bound(phrases_in(lowered(text), every), lambda found: counted(found, high, every) - counted(found, low, every))
    least, most = fixed.README_RANGE
    return F.greatest(F.lit(least), F.least(F.lit(most), balance))


def description_signals(description: Column, topics: Column) -> dict[str, Column]:
    text = F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(topics, F.lit("")))
    wrapper, original = hits(F.lower(text), fixed.WRAPPER_PHRASES, fixed.ORIGINAL_PHRASES)
    return {
        "desc_fork_wrapper_signals": wrapper,
        "desc_originality_signals": original,
        "desc_length": F.coalesce(F.length(description), F.lit(0)),
    }


def classify(name: Column, description: Column, topics: Column, language: Column,
             rules=fixed.CATEGORY_RULES, by_name: dict[str, Sequence[str]] | None = None
             ) -> Column:
    """Category and bonus as a struct.

    A known name decides alone and carries no bonus. Otherwise the first rule wins that
    has a phrase in the text and admits the language; a rule that fails its language gate
    leaves the later ones in play. Null text counts as empty. Few phrases are looked for rule
    by rule, so those of later rules only where no earlier one holds.
    """
    by_name = fixed.CATEGORY_BY_NAME if by_name is None else by_name
    known = {n: category for category, names in by_name.items() for n in names}
    text = F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(topics, F.lit("")))

    def outcome(category, bonus):
        return F.struct(F.lit(category).alias("category"), F.lit(float(bonus)).alias("bonus"))

    every = sorted({p for _, _, phrases, _ in rules for p in phrases})

    def first_rule(among):
        ruled = F.when(F.lit(False), outcome(fixed.DEFAULT_CATEGORY, 0.0))
        for category, bonus, phrases, languages in rules:
            hit = among(phrases)
            if languages:
                hit = F.coalesce(language.isin(list(languages)), F.lit(False)) & hit
            ruled = ruled.when(hit, outcome(category, bonus))
        return ruled.otherwise(outcome(fixed.DEFAULT_CATEGORY, 0.0))

    if len([p for p in every if p]) <= FEW_PHRASES:
        ruled = bound(F.lower(text), lambda t: first_rule(lambda wanted: contains_one(t, wanted)))
    else:
        ruled = bound(phrases_in(F.lower(text), every), lambda found: first_rule(
            lambda wanted: mentions(found, wanted, every)))
    if not known:
        return ruled
    named = lookup(name, known, None)
    return F.when(named.isNotNull(), F.struct(named.alias("category"),
                                              F.lit(0.0).alias("bonus"))).otherwise(ruled)


def strip_markdown(text: Column, unicode: bool = True) -> Column:
    """Markdown to running text. ``unicode`` widens white space to every script's."""
    flags = "(?Ud)" if unicode else "(?d)"
    for pattern, replacement in fixed.MARKDOWN_STEPS:
        text = F.regexp_replace(text, flags + pattern, replacement)
    return trim_all(text)


def excerpt(clean: Column) -> dict[str, Column]:
    """Excerpt of cleaned text; text too short to judge counts as not found."""
    enough = F.length(clean) >= fixed.EXCERPT_MIN
    cut = trim_all(F.substring(clean, 1, fixed.EXCERPT_LEN))
    return {
        "readme_found": F.coalesce(enough, F.lit(False)),
        "readme_excerpt": F.when(enough, cut).otherwise(F.lit("")),
    }


def language_key(label: Column) -> Column:
    return lookup(F.lower(trim_all(F.coalesce(label, F.lit("")))), fixed.LANGUAGE_LABELS, "")


def decode_base64(payload: Column) -> Column:
    """Base64 to text; bytes that are no UTF-8 become U+FFFD, bad base64 gives null."""
    raw = F.try_to_binary(F.regexp_replace(payload, r"\s", ""), F.lit("base64"))
    return F.make_valid_utf8(raw.cast("string"))


def search_terms(dep: Column, language: Column) -> Column:
    """Terms a dependency may appear under in source text, at least 3 characters each."""
    name = F.when(F.contains(dep, F.lit("/")),
                  F.substring(dep, F.instr(dep, "/") + 1, F.length(dep))).otherwise(dep)
    bare = name
    for affix in fixed.NAME_AFFIXES:
        bare = F.replace(bare, F.lit(affix), F.lit(""))
    rust = F.lower(F.coalesce(language, F.lit(""))) == "rust"

    def snake(x):
        return F.when(rust, F.replace(x, F.lit("-"), F.lit("_")))

    terms = F.array_compact(F.array(name, bare, snake(name), snake(bare)))
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) >= 3))
