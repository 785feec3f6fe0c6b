"""Cuts source code, in the stage that reads it, into the short pieces that usage patterns can match.

A usage pattern is a search term in a fixed surrounding: a keyword and white space before it, or
quotes around it, or a member access behind it. Without the term, the surrounding still says where
the pattern could match and how far. Each lexer finds those places and keeps the piece of text
there, so that a pattern matches the text as often as it matches the pieces. Terms are names: word
characters and ``@ / . : + ~ -``. Pieces are short, and equal ones of a file are counted together.

Three ways of counting keep that exact:

``each``  every match inside the piece counts;
``once``  the piece is one place, at which the pattern matches or not;
``group`` pieces with one number are one place, which counts once if any of them matches;
``gaps``  pieces lie between two quotes and have the gap's number; a match takes both quotes, so of
          neighbouring gaps every second one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bound

#: A character of a name, and a whole name, which never gives back what it took.
NAME = r"[\w@/.:+~\-]"
WHOLE = rf"{NAME}++"
QUOTED = rf"""['"]{NAME}*+['"]"""

#: (family, measure, number of the pattern) -> (way of counting, place). The place's first group is
#: the piece; it is looked ahead at, so places may overlap.
PLACES = {
    ("rust", "imports", 0): ("once", rf"\b(?=(use\s+{WHOLE}\s*+\S{{0,2}}))"),
    ("rust", "imports", 1): ("once", rf"\b(?=(extern\s+crate\s+{WHOLE}))"),
    ("python", "imports", 0): ("once", rf"^(?=(import\s+{WHOLE}))"),
    ("python", "imports", 1): ("once", rf"^(?=(from\s+{WHOLE}\s?))"),
    ("python", "aliases", 0): ("once", rf"^(?=(import\s+{WHOLE}\s+as\s+\w++))"),
    ("python", "binds", 0): ("once", rf"^(?=(import\s+{WHOLE}\s+as\s+\w++))"),
    ("python", "binds", 1): ("once", rf"^(?=(from\s+{NAME}+\s*import\s+\w+\s+as\s+\w++))"),
    ("javascript", "imports", 0): ("once", rf"(?=(from\s+{QUOTED}))"),
    ("javascript", "imports", 1): ("once", rf"(?=(require\s*\(\s*{QUOTED}\s*\)))"),
    ("javascript", "aliases", 0): ("once", rf"""(?=(import\s+\*\s+as\s+\w+\s+from\s+['"]{NAME}*+))"""),
    ("javascript", "binds", 0): ("once", rf"""(?=(import\s+\*\s+as\s+\w+\s+from\s+['"]{NAME}*+))"""),
    ("javascript", "binds", 1): ("once", rf"""(?=((?:const|let|var)\s+\w+\s*=\s*require\s*\(\s*['"]{NAME}*+))"""),
    ("javascript", "binds", 2): ("once", rf"(?=(import\s+\w+\s+from\s+{QUOTED}))"),
    ("java", "imports", 0): ("once", rf"^(?=(import\s+{WHOLE}))"),
    ("csharp", "imports", 0): ("once", rf"^(?=(using\s+{WHOLE}))"),
    ("ruby", "imports", 0): ("once", rf"""(?=(require\s+['"]{NAME}*+))"""),
    ("nim", "imports", 0): ("once", rf"^(?=(import\s+{WHOLE}))"),
}

#: family -> (a name with what may follow it, which of them can be a use).
USES = {
    "rust": (f"{WHOLE}", r"::\w"),
    "go": (rf"{WHOLE}(?:\s*\()?", r"\.\w"),
    "python": (rf"{WHOLE}(?:\s*[(\[])?", r"\.\w"),
    "javascript": (rf"{WHOLE}(?:\s*[(\[])?", r"\.\w"),
    "java": (rf"{WHOLE}\(?", r"[.(]"),
    "csharp": (rf"{WHOLE}(?:\s*[(\[])?", r"\.\w"),
    "ruby": (f"{WHOLE}", r"[.:]\w"),
    "nim": (f"{WHOLE}", r"\.\w"),
    "other": (f"{WHOLE}", r"[.:]\w"),
}

PIECE = "array<struct<measure:string,pattern:int,way:string,number:int,piece:string>>"


def piece(measure: str, pattern: int, way: str, number: Column | int, text: Column) -> Column:
    number = F.lit(number) if isinstance(number, int) else number
    return F.struct(F.lit(measure).alias("measure"), F.lit(pattern).alias("pattern"), F.lit(way).alias("way"),
                    number.alias("number"), text.alias("piece"))


def found(content: Column, pattern: str, flags: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(flags + pattern), F.lit(group))


def as_piece(measure: str, pattern: int, way: str, text=lambda x: x, number: Column | int = -1):
    """Function text -> piece."""
    return lambda x: piece(measure, pattern, way, number, text(x))


def attributes(content: Column, flags: str) -> Column:
    """Names in each attribute, and in each list of derived traits: the first is the attribute's
    own, and patterns ask of it that it begins with the term."""
    places = found(content, rf"#\[(derive\([^)]*+|{NAME}*+)", flags)

    def names(place, number):
        return F.transform(found(place, f"({WHOLE})", flags), lambda name, i: piece(
            "calls", 1, "group", number, F.concat(F.when(i == 0, "#[").otherwise("#[derive("), name)))

    return F.flatten(F.transform(places, names))


def gaps(content: Column, flags: str) -> Column:
    """Names between two quotes, for each pattern whose surrounding the gap has."""
    sides = [("imports", 0, -1, r"import\s+\z"), ("imports", 1, 1, r"\A\s*\n"), ("aliases", 0, -1, r"\w\s+\z")]

    def listed(parts):
        def names_of(i):
            names = F.array_distinct(found(F.get(parts, i), f"({WHOLE})", flags))
            return bound(names, lambda own: F.flatten(F.array(*[
                F.when(F.get(parts, i + side).rlike(flags + pattern), F.transform(own, as_piece(m, p, "gaps", number=i)))
                .otherwise(F.array().cast(PIECE)) for m, p, side, pattern in sides])))

        last = F.size(parts) - 2
        return F.when(last >= 1, F.flatten(F.transform(F.sequence(F.lit(1), last), names_of))).otherwise(F.array().cast(PIECE))

    return bound(F.split(content, '"'), listed)  # split once, not for every gap


def quoted_names(content: Column, flags: str) -> Column:
    """Names that fill the space between two quotes of any kind."""
    def listed(parts):
        inner = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x, i: piece(
            "imports", 0, "gaps", i + 1, F.concat(F.lit("'"), x, F.lit("'"))))
        return F.filter(inner, lambda x: x["piece"].rlike(flags + rf"\A'{WHOLE}'\z"))

    return bound(F.split(content, """["'`]"""), listed)


def pieces_of(content: Column, family: str, unicode: bool) -> Column:
    """All pieces of one text of a family."""
    flags = "(?Udm)" if unicode else "(?dm)"
    parts = []
    for (own, measure, number), (way, place) in PLACES.items():
        if own == family:
            parts.append(F.transform(found(content, place, flags), as_piece(
                measure, number, way, lambda x: F.regexp_replace(x, flags + r"\s+", " "))))
    shape, useful = USES[family]
    uses = F.filter(found(content, rf"(?<!{NAME})({shape})", flags), lambda x: x.rlike(flags + useful))
    parts.append(F.transform(uses, lambda x: piece("calls", 0, "each", -1, F.regexp_replace(x, flags + r"\s+", ""))))
    if family == "rust":
        parts.append(attributes(content, flags))
    if family == "go":
        parts.append(gaps(content, flags))
    if family == "other":
        parts.append(quoted_names(content, flags))
    return F.concat(*[p.cast(PIECE) for p in parts])


def by_family(language: Column, value, families: dict[str, list[str]]) -> Column:
    """``value(family)`` of the family whose languages include this one, else of ``other``."""
    chosen = None
    for family, languages in families.items():
        here = language.isin(languages)
        chosen = F.when(here, value(family)) if chosen is None else chosen.when(here, value(family))
    return chosen.otherwise(value("other"))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def token_index(files: DataFrame, families: dict[str, list[str]], unicode: bool = True) -> DataFrame:
    """``repo, path, language, measure, pattern, way, number, piece, n`` of ``repo, path, language,
    content``: the pieces of each file, equal ones counted before they leave the scan."""
    def pieces(content):
        def of(wide):
            return by_family(F.col("language"), lambda f: pieces_of(content, f, wide), families)

        # in text that is all ASCII both kinds of classes mean the same, and the narrow ones are faster
        return F.when(is_ascii(content), of(False)).otherwise(of(True)) if unicode else of(False)

    own = bound(F.col("content"), pieces)  # the text is made once, however it is made
    each = files.select("repo", "path", "language", F.inline(own))
    return each.groupBy("repo", "path", "language", "measure", "pattern", "way", "number", "piece").agg(
        F.count(F.lit(1)).alias("n"))


def names_in(files: DataFrame, unicode: bool = True) -> DataFrame:
    """``repo, path, name``: the different names in each file, in lower case."""
    def names(text, flags):
        return F.array_distinct(found(text, f"({WHOLE})", flags))

    own = bound(F.lower("content"), lambda text: F.when(is_ascii(text), names(text, "")).otherwise(
        names(text, "(?U)" if unicode else "")))
    return files.select("repo", "path", F.explode(own).alias("name"))
