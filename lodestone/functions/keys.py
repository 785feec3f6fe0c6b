"""Join keys made from project URLs.

Sources spell the same project in several ways, and the spellings do not all agree, so
each join says which of these it uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import HOST


# The characters that count as white space.
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
         "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, where SQL ``trim`` takes blanks only."""
    return F.btrim(text, F.lit(WHITE))


def slug(url: Column, host: str = HOST, strip_slash: bool = True) -> Column:
    """Lower-case ``owner/name``."""
    text = F.lower(url)
    if strip_slash:
        text = F.rtrim(text, F.lit("/"))
    return F.replace(text, F.lit(host), F.lit(""))


def slug_keep_case(url: Column, host: str = "github.com/") -> Column:
    """``owner/name`` after the last mention of the host, case kept."""
    return F.substring_index(F.rtrim(url, F.lit("/")), host, -1)


def canonical(url: Column, host: str = HOST, scheme: str = "https://") -> Column:
    """Full URL: a bare ``owner/name`` gets the host in front. Case kept."""
    text = F.rtrim(trim_all(url), F.lit("/"))
    return F.when(F.startswith(text, F.lit(scheme)), text).otherwise(
        F.concat(F.lit(host), text))


def owner_and_name(url: Column, pattern: str = r"^https?://github\.com/([^/]+)/([^/]+)"
                   ) -> tuple[Column, Column]:
    """Owner and name by pattern; null where the URL does not fit."""
    text = F.rtrim(trim_all(url), F.lit("/"))
    return tuple(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in (1, 2))


def leaf(url: Column) -> Column:
    """Last path segment."""
    return F.substring_index(url, "/", -1)
