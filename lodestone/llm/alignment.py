"""Alignment of two tokenizers' tokens over the bytes of a text.

Coarse cuts come from the libraries: character offsets of the byte-level tokenizer, and spans of
the piece tokenizer's immutable proto. They say nothing inside a character that several tokens
share (offsets repeat the whole character, spans of byte fallback are empty until its last byte),
so there the decoded bytes of the tokens give the cuts, starting from the last coarse one.

Neither tokenizer merges across the start of a run of white space, or from a letter to a mark: the
byte-level one cuts there itself, and no piece of the other holds such a place (which is looked
at). So each different word is cut and aligned once and kept in a table of bounded size, and texts
are put together from its rows. A text with a character for which that is not certain,
or with a word that does not give back its own bytes, is cut whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import chunks_of, text_beside

MOST_WORDS = 1 << 18
LOT_TEXTS = 4096
LOT_CHARACTERS = 1 << 20
LONG_WORD = 64
HOT_PAIRS = 1 << 17
SPACE = "▁"

#: Characters of old standing in Unicode, of which all pattern engines think alike.
PLAIN = re.compile(r"[\t\n\x20-\x7e\xa0-ɏ‐-‧€]*")
WHITE = "\t\n\xa0 "  # white space among them
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-ɏ", ",.;:!?"
WORD = re.compile(rf"(?:\s+|[{MARK}])(?:[^\s{MARK}]+|(?<![{LETTER}])[{MARK}])*")


def byte_places(text: str) -> np.ndarray:
    """Byte at which each character begins, and the end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.r_[0, np.cumsum(widths)].astype(np.int64)


def refine(coarse: np.ndarray, sure: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse end where it is sure, elsewhere counted on by decoded
    bytes from the last sure one."""
    counted = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(sure)), -1))
    drift = np.where(last >= 0, coarse[last] - counted[last], 0)
    return np.where(sure, coarse, counted + drift)


def flat(lists: list, width: int = 1) -> np.ndarray:
    """Whole numbers of many lists (of tuples of ``width``) in one array."""
    values = np.fromiter(chain.from_iterable(chain.from_iterable(lists) if width > 1 else lists), np.int64)
    return values.reshape(-1, width) if width > 1 else values


class ByteLevel:
    """A byte-level tokenizer of the ``tokenizers`` library. Special tokens' strings are text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        names = (self.model.id_to_token(i) or "" for i in range(self.model.get_vocab_size()))
        self.bytes = [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in names]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes in bytes, tokens of each text) of all texts, one after another."""
        found = self.model.encode_batch(texts, add_special_tokens=False)
        ids = flat([x.ids for x in found])
        counts = np.array([len(x) for x in found], np.int64)
        spans = flat([x.offsets for x in found], 2)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        spans += np.repeat(np.cumsum(length) - length, counts)[:, None]
        ends = byte_places("".join(texts))[spans[:, 1]]
        # a token's end is its own where the next one begins there, not inside its last character
        sure = np.r_[spans[1:, 0] >= spans[:-1, 1], [True] * (len(ids) > 0)]
        return ids, np.diff(refine(ends, sure, self.sizes[ids]), prepend=0), counts


class Pieces:
    """A sentencepiece tokenizer with byte fallback, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode()
                      for i, n in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.space = self.model.piece_to_id(SPACE)
        # words are cut apart only if no piece goes over the places where they are
        over = re.compile(f"[^{SPACE}].*[{WHITE}{SPACE}]|{SPACE}[{WHITE}]|[{LETTER}][{MARK}]", re.S)
        self.by_word = not any(map(over.search, names)) and self.model.encode("a") == [self.model.piece_to_id(SPACE + "a")]

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes in bytes, tokens of each text) of all texts, one after another. The space
        that the library puts first is a text's own if it begins with one; others are cut behind
        a letter, whose token goes."""
        own = [t[:1] == " " for t in texts]
        found = self.model.encode([t[1:] if o else "a" + t for t, o in zip(texts, own)], return_type="proto", num_threads=1) if texts else []
        # the library gives nothing for an empty text
        rows = [[(p.id, p.begin, p.end) for p in x.pieces][not o:] if t != " " else [(self.space, 0, 0)]
                for t, x, o in zip(texts, found, own)]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        ids, begins, ends = flat(rows, 3).T
        length = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        # spans are in bytes of what was cut: less the space, or with the letter
        base = np.repeat(np.cumsum(length) - length + np.where(own, 1, -1), counts)
        sure = ends > begins  # the space alone, and fallback bytes but the last, are empty
        return ids, np.diff(refine(base + ends, sure, self.sizes[ids]), prepend=0), counts


class Lines:
    """Writes groups as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size: int):
        digits = [str(i) for i in range(size)]
        self.to = [np.array([d + c for d in digits], object) for c in ",|;"]

    def pieces(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """One piece of text for each token, groups in order, in each its tokens of a before those
        of b. ``last_a``, ``last_b``: is a token the last of its group?"""
        out = np.empty(len(a) + len(b), object)
        ends_a, ends_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        text_a, text_b = self.to[0][a], self.to[0][b]
        text_a[ends_a], text_b[ends_b] = self.to[1][a[ends_a]], self.to[2][b[ends_b]]
        out[np.arange(len(a)) + np.r_[0, ends_b + 1][group_a]] = text_a
        out[np.arange(len(b)) + (ends_a + 1)[group_b]] = text_b
        return out.tolist()


def ragged(count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the entries of rows ``at``, where rows of ``count`` entries lie end to end."""
    n = count[at]
    starts = np.cumsum(count, dtype=np.int64) - count
    return np.arange(n.sum()) + np.repeat(starts[at] - np.cumsum(n, dtype=np.int64) + n, n)


@dataclass
class Aligned:
    """Texts in rows: tokens of each, their bytes, and their groups (byte at which a group ends
    and id pair of its last tokens, end to end), also written as a line. ``sound``: do both
    tokenizers give back the text's bytes?"""

    n_a: np.ndarray
    n_b: np.ndarray
    size: np.ndarray
    groups: np.ndarray
    sound: np.ndarray
    cuts: np.ndarray
    pairs: np.ndarray
    lines: list[str]

    def add(self, more: Aligned) -> Aligned:
        return Aligned(*(np.concatenate([x, y]) if isinstance(x, np.ndarray) else x + y
                         for x, y in zip(vars(self).values(), vars(more).values())))


NOTHING = Aligned(*[np.zeros(0, np.int32)] * 4, np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0, np.int64), [])


class Aligner:
    """Aligns two tokenizers. A table of different words takes those of up to 64 characters until
    it is full; others are aligned anew with every lot of texts. If most of a lot is not in a full
    table, it starts again."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.wide = len(b.bytes)
        self.write = Lines(max(len(a.bytes), len(b.bytes)))
        self.place: dict[str, int] = {}
        self.table = NOTHING

    def sound(self, tokenizer, texts: list[str], cut: tuple[np.ndarray, ...]) -> np.ndarray:
        """Do the tokens of each text give back its bytes, cut where their sizes say?"""
        ids, sizes, count = cut
        bytes_of = tokenizer.bytes.__getitem__
        if np.array_equal(sizes, tokenizer.sizes[ids]) and np.array_equal(
                np.add.reduceat(np.r_[sizes, 0], np.cumsum(count) - count) * (count > 0), [len(t.encode()) for t in texts]):
            if b"".join(map(bytes_of, ids.tolist())) == "".join(texts).encode():
                return np.ones(len(texts), bool)
        ends = np.cumsum(count)
        return np.array([b"".join(map(bytes_of, ids[i:j].tolist())) == t.encode() and np.array_equal(sizes[i:j], tokenizer.sizes[ids[i:j]])
                         for t, i, j in zip(texts, ends - count, ends)], bool)

    def align(self, texts: list[str]) -> Aligned:
        """Of texts that begin with white space or a mark, each by itself, some thousand at a time."""
        lots = [self.align_lot(texts[i:i + LOT_TEXTS]) for i in range(0, len(texts), LOT_TEXTS)]
        return reduce(Aligned.add, lots, NOTHING)

    def align_lot(self, texts: list[str]) -> Aligned:
        """Those that are not sound have no tokens."""
        (a, a_size, n_a), (b, b_size, n_b) = cuts = self.a.cut(texts), self.b.cut(texts)
        ok = self.sound(self.a, texts, cuts[0]) & self.sound(self.b, texts, cuts[1])
        keep_a, keep_b, n_a, n_b = np.repeat(ok, n_a), np.repeat(ok, n_b), np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        a, b, a_ends, b_ends = a[keep_a], b[keep_b], np.cumsum(a_size[keep_a]), np.cumsum(b_size[keep_b])
        # the bytes of the texts are laid end to end, the same for both, so all are compared at once
        at = np.searchsorted(b_ends, a_ends)
        last_a, last_b = b_ends[at] == a_ends, np.zeros(len(b), bool)
        last_b[at[last_a]] = True
        size = np.array([len(t.encode()) for t in texts], np.int64) * ok
        owner = np.repeat(np.arange(len(texts)), n_a)[last_a]
        written = self.write.pieces(a, b, last_a, last_b)
        ends = np.cumsum(n_a + n_b).tolist()
        narrow = [x.astype(np.int32) for x in (n_a, n_b, size, np.bincount(owner, minlength=len(texts)))]
        return Aligned(*narrow, ok, (a_ends[last_a] - (np.cumsum(size) - size)[owner]).astype(np.int32),
                       a[last_a] * self.wide + b[last_b], ["".join(written[i:j])[:-1] for i, j in zip([0, *ends], ends)])

    def look_up(self, words: list[list[str]]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """(table, its row for every word, words of each text)."""
        each = np.fromiter(map(len, words), np.int64, len(words))
        every = list(chain.from_iterable(words))
        at = np.fromiter(map(self.place.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.table, at, each
        if len(self.place) >= MOST_WORDS and 2 * len(missing) > len(every):
            self.place, self.table = {}, NOTHING
            return self.look_up(words)
        lost = [every[i] for i in missing.tolist()]
        new = dict.fromkeys(lost)
        brief = [w for w in new if len(w) <= LONG_WORD][:max(0, MOST_WORDS - len(self.place))]
        if brief:
            self.place.update(zip(brief, range(len(self.place), len(self.place) + len(brief))))
            self.table = self.table.add(self.align(brief))
        others = [w for w in new if w not in self.place]
        extra = dict(zip(others, range(len(self.place), len(self.place) + len(others))))
        at[missing] = [extra[w] if w in extra else self.place[w] for w in lost]
        return self.table.add(self.align(others)) if others else self.table, at, each

    def texts(self, texts: list[str]) -> Aligned:
        """Of any texts: those that are empty or not sound have no tokens."""
        some = [" " + t if t else "" for t in texts]
        words = [[] if not t else WORD.findall(t) if self.b.by_word and PLAIN.fullmatch(t) else [t] for t in some]
        table, at, each = self.look_up(words)
        owner = np.repeat(np.arange(len(texts)), each)
        broken = np.unique(owner[~table.sound[at]])
        if any(len(words[i]) > 1 for i in broken):  # a word that is not sound by itself may be in its place
            for i in broken:
                words[i] = [some[i]]
            table, at, each = self.look_up(words)
            owner = np.repeat(np.arange(len(texts)), each)

        def total(values):
            return np.bincount(owner, values[at], len(texts)).astype(np.int64)

        size, rows = table.size[at].astype(np.int64), at.tolist()
        base = np.cumsum(size) - size
        first = np.r_[base, 0][np.minimum(np.cumsum(each) - each, len(base))]
        pick = ragged(table.groups, at)
        start = np.repeat(base - first[owner], table.groups[at])
        ends = np.cumsum(each).tolist()
        lines = [";".join(map(table.lines.__getitem__, rows[i:j])) for i, j in zip([0, *ends], ends)]
        return Aligned(total(table.n_a), total(table.n_b), total(table.size), total(table.groups), total(table.sound) > 0,
                       start + table.cuts[pick], table.pairs[pick], lines)


_KEPT: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """Kept per worker."""
    if (path_a, path_b) not in _KEPT:
        _KEPT[path_a, path_b] = Aligner(ByteLevel(path_a), Pieces(path_b))
    return _KEPT[path_a, path_b]


def align(docs: DataFrame, text: str, path_a: str, path_b: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` of every row, and how the tokens of tokenizer a (``path_a``, byte-level,
    library ``tokenizers``) and b (``path_b``, ``sentencepiece`` with byte fallback) lie over a
    space and the text.

    ``n_a, n_b``: tokens. Byte offsets where tokens of both end cut them in ``n_groups`` groups:
    ``cuts`` has the offsets, ``groups`` the ids as ``a1,a2|b1;a3|b2``. Tokens that end together
    are linked: ``n_links``, and ``links`` with each id pair of the text and how often it is linked.
    No token is without bytes, so a group has one link, between its last tokens.

    Texts that are null or empty, or that either tokenizer does not give back byte for byte, have
    no tokens: zeros and empty values. Repeated rows give equal results, an empty table none. Kept
    columns may have any names but those above. A text is held whole, beside others of about a
    million characters.
    """
    made = T._parse_datatype_string(
        "n_a long, n_b long, n_groups long, n_links long, cuts array<long>, groups string, "
        "links array<struct<a:int,b:int,n:int>>")
    source, place = text_beside(docs, text, keep)
    kept = docs.select(*keep).schema.fields if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        pairs = len(both.a.bytes) * both.wide
        for batch in batches:
            for first, texts in chunks_of(batch.column(place), LOT_CHARACTERS):
                x = both.texts(texts)
                owner = np.repeat(np.arange(len(texts)), x.groups)
                key, n = np.unique(owner * pairs + x.pairs, return_counts=True)
                pair = key % pairs
                listed = pa.StructArray.from_arrays(
                    [pa.array(v.astype(np.int32)) for v in (pair // both.wide, pair % both.wide, n)], names=["a", "b", "n"])
                cut_at, link_at = (pa.array(np.r_[0, np.cumsum(v)].astype(np.int32)) for v in (
                    x.groups, np.bincount(key // pairs, minlength=len(texts))))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(first, len(texts)) for i in range(len(kept))],
                     *[pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.groups, x.groups)],
                     pa.ListArray.from_arrays(cut_at, pa.array(x.cuts)), pa.array(x.lines, pa.string()),
                     pa.ListArray.from_arrays(link_at, listed)],
                    names=[*[f.name for f in kept], *made.names])

    return source.mapInArrow(run, T.StructType([*kept, *made.fields]))


def pair_counts(links: DataFrame) -> DataFrame:
    """``a, b, count, best``: how many links hold each id pair, and whether that is the most of
    its b id. ``links``: a, b, n. Counts are combined before the shuffle, and there are no more
    maxima than ids of b."""
    counts = cut_lineage(links.groupBy("a", "b").agg(F.sum("n").alias("count")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return cut_lineage(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")))


def weighed(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` without ``links`` but with ``count_sum``, the corpus-wide count of its links
    summed, and ``n_best``, its links whose count is the highest of their b id.

    ``aligned`` is written once. The ``hot_pairs`` most frequent pairs, which hold nearly all
    links, are looked up by broadcast (a bounded table); the others are joined, and none of them
    is frequent enough to fill a task.
    """
    held = cut_lineage(aligned.withColumn("_row", F.monotonically_increasing_id()))
    each = held.select("_row", F.explode("links").alias("l")).select("_row", "l.a", "l.b", "l.n")
    pairs = pair_counts(each.select("a", "b", "n"))
    hot = F.broadcast(pairs.orderBy(F.desc("count"), "a", "b").limit(hot_pairs))
    sums = [F.sum(F.col("n") * F.col("count")).alias("s"),
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("t")]
    near = each.join(hot, ["a", "b"]).groupBy("_row").agg(*sums)
    cold = pairs.join(hot, ["a", "b"], "left_anti")
    far = each.join(hot, ["a", "b"], "left_anti").join(cold, ["a", "b"]).groupBy("_row").agg(*sums)
    total = near.union(far).groupBy("_row").agg(F.sum("s").alias("count_sum"), F.sum("t").alias("n_best"))
    return held.drop("links").join(total, "_row", "left").drop("_row").withColumns({
        c: F.coalesce(c, F.lit(0)).cast("long") for c in ("count_sum", "n_best")})
