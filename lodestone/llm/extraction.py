"""Main text of web pages by scoring their trees.

A page is read as a tree of elements with blocks of text. Parts that are never article text
are left out. Each block passes points for its length and commas to the elements around it,
less the farther they are; an element's points are discounted by the share of its text that is
links. The best container is kept with those of its siblings that look like part of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = re.compile(r"<(?:(!--)|([!?])|(/)?([a-zA-Z][^\s/>]*)|/)")
QUOTE_OR_END = re.compile(r"""=\s*+(["'])|>""")
NAMES = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-hidden|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
# Elements of the markup language by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
            "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol "
            "optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
LEAVE_OUT = set("head nav footer aside form menu dialog search select button svg math canvas object audio "
                "video template".split()) | RAW
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
WALLS = set("ul ol dl table tbody thead tfoot tr body html article section div td th select".split())
PARAGRAPH_WALLS = WALLS | {"li", "dd", "blockquote", "figure", "header", "main"}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
CHROME = set("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment "
             "comments comentarios cookie cookies consent dfp disqus footer form header login masthead menu menus "
             "modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
             "promoted promotion related recommended recommendations replies reply respond rss share sharing "
             "shoutbox sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets "
             "copyright legal disclaimer paywall".split())
CHROME |= {"tag", "tags", "byline", "toc"}
CONTENT = set("article body content entry main post story text".split())
TITLES = {"header", "banner", "masthead"}
LEVELS = 64
ALWAYS = set("comment comments disqus sidebar ad ads advert advertisement newsletter related".split())
PARTS = set("a b i em strong span p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd tr tbody thead tfoot table".split())
PAGE = {"html", "body", "main", "article"}


def class_words(value: str) -> list[list[str]]:
    """Words of each class or id: split at marks and at changes of case."""
    return [[w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", token)] for token in value.split()]


def is_chrome(name: str, attrs: str, inside_article: bool) -> bool:
    """Is this element never article text, judged by its name and attributes?"""
    if name in LEAVE_OUT:
        return True
    for found in NAMES.finditer(attrs) if attrs else ():
        key, value = found.group(1).lower(), (found.group(2) or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in PAGE or name == "header":
            continue
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and any(map(named_chrome, class_words(value))):
            return True
    return name == "header" and not inside_article


def named_chrome(words: list[str]) -> bool:
    """Does a class or id name a part beside the text? The last word says what a thing is
    (``post-navigation``, ``article-share``), the first what it belongs to (``nav-item``); a
    title of the text (``entry-header``) is text, and so is content in such a place."""
    if not words or words[0] in ("no", "has", "with", "without", "is"):
        return False
    first, last, whole = words[0], words[-1], "".join(words)
    if {first, last, whole} & ALWAYS or whole in CHROME:
        return True
    if last in CHROME:
        return not (last in TITLES and set(words) & CONTENT)
    return first in CHROME and not set(words) & CONTENT


class Page:
    """Elements of a page (parent, name, depth first) and its blocks of text.

    One pass, in time that grows with the page however it is broken or nested: what depends on the
    elements around is carried down, names are looked for only where one is open, and a tag that
    never ends is not looked through again.
    """

    def __init__(self, source: str):
        self.parent, self.name, self.chrome = [-1], ["#root"], [False]
        self.block, self.in_article, self.stop = [0], [False], [0]  # innermost block; nearest paragraph or wall
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of links
        self.stack, self.pieces, self.linked = [0], [], 0
        self.opened = Counter()
        self.source, self.quotes, self.last = source, True, source.rfind(">")
        self.read()
        self.flush()

    def flush(self) -> None:
        """Ends a block: white space becomes one space; the element is the innermost block."""
        text = " ".join("".join(self.pieces).split())
        if text and not self.chrome[self.stack[-1]]:
            self.blocks.append((self.block[self.stack[-1]], text, min(len(text), self.linked)))
        self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.chrome[self.stack[-1]]:
            shown = html.unescape(raw)
            self.pieces.append(shown)
            if any(self.name[e] == "a" for e in self.stack[-4:]):
                self.linked += len("".join(shown.split()))

    def drop(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        gone = self.stack[depth:]
        if any(self.name[e] in BLOCK for e in gone):
            self.flush()
        for e in gone:
            self.opened[self.name[e]] -= 1
        del self.stack[depth:]

    def close(self, names: set[str], walls: set[str]) -> None:
        """Ends the innermost open element of these names, unless a wall comes first."""
        if not any(self.opened[n] for n in names):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.name[self.stack[depth]]
            if name in names:
                return self.drop(depth)
            if name in walls:
                return

    def close_paragraph(self) -> None:
        depth = self.stop[self.stack[-1]]
        if self.name[self.stack[depth]] == "p":
            self.drop(depth)

    def open(self, name: str, attrs: str) -> None:
        if name in BLOCK:
            self.flush()
            self.close_paragraph()
            if name in CLOSED_BY:
                self.close(CLOSED_BY[name], WALLS - CLOSED_BY[name] - {"tr"} if name in ("tr", "tbody") else WALLS - CLOSED_BY[name])
        if name in VOID:
            if name == "br":
                self.pieces.append(" ")
            return
        up, here = self.stack[-1], len(self.name)
        self.parent.append(up)
        self.name.append(name)
        self.chrome.append(self.chrome[up] or is_chrome(name, attrs, self.in_article[up]))
        self.block.append(here if name in BLOCK else self.block[up])
        self.in_article.append(self.in_article[up] or name in ("article", "main"))
        self.stop.append(len(self.stack) if name == "p" or name in PARAGRAPH_WALLS else self.stop[up])
        self.opened[name] += 1
        self.stack.append(here)

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag which is open at ``at``, values in quotes passed
        over; -1 if there is none. If quotes leave a tag without end, from there on they mean
        nothing."""
        place = at
        while self.quotes:
            found = QUOTE_OR_END.search(self.source, place)
            if not found:
                self.quotes = False
                break
            if not found.group(1):
                return found.start()
            place = self.source.find(found.group(1), found.end()) + 1
            if not place:
                self.quotes = False
        return self.source.find(">", at) if at <= self.last else -1

    def read(self) -> None:
        at, source = 0, self.source
        while found := TAG.search(source, at):
            self.text(source[at:found.start()])
            comment, other, ends, name = found.groups()
            if comment:
                end = source.find("-->", found.end())
                at = len(source) if end < 0 else end + 3
                continue
            end = self.tag_end(found.end()) if name else source.find(">", found.end())
            if end < 0:
                if not other:  # a tag that never ends is shown as it stands
                    self.text(source[found.start():])
                at = len(source)
                break
            at = end + 1
            if not name:
                continue
            name = name.lower()
            if ends:
                self.close({name}, set() if name in BLOCK else BLOCK)
                continue
            self.open(name, source[found.end():end])
            if name in RAW:
                last = re.compile(rf"</{re.escape(name)}(?![\w-])", re.I).search(source, at)
                end = source.find(">", last.end()) if last else -1
                at = end + 1 if end >= 0 else len(source)
                self.close({name}, set())
        self.text(source[at:])


def main_blocks(source: str) -> list[str]:
    """Blocks of the main text, in page order. A block's points reach the 64 elements around it."""
    page = Page(source)
    if not page.blocks:
        return []
    n = len(page.name)
    score, chars, links = [0.0] * n, [0] * n, [0] * n
    for at, text, linked in page.blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        level, e = 0, at if page.name[at] in WALLS - {"td", "th"} | {"main", "body", "#root"} else page.parent[at]
        while e >= 0 and level < LEVELS:
            score[e] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            level, e = level + 1, page.parent[e]
        chars[at] += len(text)
        links[at] += linked
    for e in range(n - 1, 0, -1):  # parents come before their children
        chars[page.parent[e]] += chars[e]
        links[page.parent[e]] += links[e]
    final = [score[e] * (1 - links[e] / max(1, chars[e])) for e in range(n)]
    best = max(range(n), key=lambda e: (final[e], e))
    while best > 0 and page.name[best] in PARTS:
        best = page.parent[best]
    e = best
    while e > 0:
        if page.name[e] in ("article", "main"):
            best = e
            break
        e = page.parent[e]
    kept, floor = {best}, max(2.0, 0.2 * final[best])
    for e in range(n):
        if page.parent[e] == page.parent[best] and e != best and chars[e]:
            density = links[e] / chars[e]
            title = page.name[e] in ("h1", "h2") and e < best
            prose = page.name[e] == "p" and density < 0.25 and chars[e] > 80
            if title or prose or page.name[e] in WALLS and final[e] >= floor and page.name[best] not in PAGE:
                kept.add(e)
    inside = [False] * n
    for e in range(n):
        inside[e] = e in kept or page.parent[e] >= 0 and inside[page.parent[e]]
    return [text for at, text, _ in page.blocks if inside[at]]


def extract(pages: DataFrame, html_column: str, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``text``, the main text: its blocks joined by a line feed.

    Character references are decoded and white space inside a block becomes one space. Null
    and empty pages, and pages without text, give ''. Repeated rows give equal texts, an empty
    table none. Whole pages, however broken or deep, one at a time, in the stage
    that reads them; nothing of the main text is dropped or cut.
    """
    kept = [c for c in keep if c != text]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ["\n".join(main_blocks(x.as_py() or "")) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(out, pa.string())], names=[*kept, text])

    return pages.select(*kept, F.col(html_column).alias("_html")).mapInArrow(run, schema)
