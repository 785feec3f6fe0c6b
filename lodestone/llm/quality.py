"""Document quality by a linear-chain conditional random field over lines.

Lines are described by binned measures of their own, of the line before and of the line after.
Forward-backward labels every line good or bad, and the probabilities, weighted by length,
make the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import crf
from .common import chunks_of, text_beside

DOCS_PER_LABEL = 1000
BINS = 6
MEASURES = 12
MARK, LETTER, UPPER, DIGIT, SPACE = range(5)
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind of every code point, made once per process."""
    if not _KINDS:
        table = np.zeros(0x110000, np.uint8)
        for code in range(0x110000):
            c = chr(code)
            table[code] = (UPPER if c.isupper() else LETTER if c.isalpha() else DIGIT if c.isdigit()
                           else SPACE if c.isspace() else MARK)
        _KINDS.append(table)
    return _KINDS[0]


def measures(lines: Sequence[str]) -> np.ndarray:
    """Twelve numbers that describe each line, most of them shares; a line without words has
    zeros. Characters are counted for all lines at once."""
    out = np.zeros((len(lines), MEASURES))
    joined = "\n".join(lines) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    size = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    starts = np.cumsum(size) - size
    counts = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(5)], 1)
    gap = kind == SPACE
    first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    last = np.flatnonzero(~gap & np.r_[gap[1:], True])
    if not len(first):
        return out
    line_of = np.searchsorted(starts, first, "right") - 1
    n = np.bincount(line_of, minlength=len(lines))
    letter = (kind == LETTER) | (kind == UPPER)
    bare = np.add.reduceat(letter, first, dtype=np.int64) == 0
    tail = (kind[last] == MARK) & (last > first) & (codes[last] == codes[np.maximum(last - 1, 0)])
    words = joined.split()
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    inner = line_of[1:] == line_of[:-1]
    same = np.bincount(line_of[1:][inner & (ids[1:] == ids[:-1])], minlength=len(lines))

    def distinct(line, value):
        """How many different values each line has."""
        base = int(value.max(initial=0)) + 1
        if len(lines) * base < 1 << 62:
            return np.bincount(np.unique(line * base + value) // base, minlength=len(lines))
        order = np.lexsort((value, line))  # numbers too large to be put together
        line, value = line[order], value[order]
        fresh = np.r_[True, (line[1:] != line[:-1]) | (value[1:] != value[:-1])]
        return np.bincount(line[fresh], minlength=len(lines))

    kinds_of = distinct(line_of, ids)
    pairs = distinct(line_of[1:][inner], (ids[:-1] * len(number) + ids[1:])[inner])
    at = n > 0
    ends = np.searchsorted(line_of, np.flatnonzero(at), "right") - 1
    closed = np.isin(codes[last[ends]], [ord(c) for c in ".!?\u2026"])
    n, size, steps = n[at], size[at] - 1, np.maximum(1, n[at] - 1)
    letters = (counts[at, LETTER] + counts[at, UPPER])
    out[at] = np.stack([
        np.log1p(n), np.bincount(line_of, bare, len(lines))[at] / n, letters / size,
        counts[at, DIGIT] / size, counts[at, MARK] / n, counts[at, UPPER] / np.maximum(1, letters),
        np.bincount(line_of, tail, len(lines))[at] / n, same[at] / steps, kinds_of[at] / n,
        1 - pairs[at] / steps, letters / n, closed], 1)
    return out


@dataclass
class Model:
    edges: np.ndarray | None = None  # measures x (bins - 1)
    weights: crf.Weights | None = None
    slope: float = 1.0
    shift: float = 0.0


def described(values: np.ndarray, lengths: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature numbers, a fixed count for each line: bins of its measures, then those of its
    neighbours, which beyond a document's ends are a bin of their own."""
    bins = np.stack([np.searchsorted(edges[k], values[:, k], "right") for k in range(MEASURES)], 1)
    first = np.zeros(len(values), bool)
    first[np.cumsum(lengths) - lengths] = True
    before, after = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    before[first] = BINS
    after[np.roll(first, -1)] = BINS
    every = np.concatenate([bins, before, after], axis=1)
    return every + np.arange(3 * MEASURES) * (BINS + 1)


def lines_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures of all lines, lines of each text, weight of each line: its letters and marks)."""
    split = [t.split("\n") for t in texts]
    lines = [x for ls in split for x in ls]
    return measures(lines), np.array([len(ls) for ls in split], np.int64), np.array([len(x) + 1.0 for x in lines])


def good_share(texts: Sequence[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length-weighted probability that a text's lines are good, lines of each text, each
    line's probability)."""
    values, lengths, weight = lines_of(texts)
    index = described(values, lengths, model.edges)
    scores = model.weights.emission[index].sum(axis=1)
    gamma, _ = crf.marginals(scores, lengths, model.weights)
    good, starts = gamma[:, 1], np.cumsum(lengths) - lengths
    share = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    return share, lengths, good


def train(sample: Sequence[tuple[int, str]], rounds: int = 60) -> Model:
    """Model from (label, text) pairs, label 1 for good. A line counts as its document's label
    says; lines both kinds have pull to neither. A last step maps a document's share to a
    probability, on the same documents."""
    texts, labels = [t for _, t in sample], np.array([int(y) for y, _ in sample])
    model = Model()
    if len(set(labels.tolist())) < 2:
        model.shift = 4.0 if len(labels) and labels[0] else -4.0 if len(labels) else 0.0
        return model
    values, lengths, weight = lines_of(texts)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    bad = np.repeat(labels, lengths) == 0
    # cut points from both kinds alike, so that what marks the rarer kind has bins of its own
    model.edges = np.sort(np.concatenate([
        np.quantile(values[~bad], cuts[::2], axis=0), np.quantile(values[bad], cuts[1::2], axis=0)]), axis=0).T
    index = described(values, lengths, model.edges)
    flat, counts = index.ravel(), np.full(len(index), index.shape[1])
    share_of_line = np.minimum(1.0, weight / np.repeat(np.add.reduceat(weight, np.cumsum(lengths) - lengths), lengths) * 4)
    model.weights = crf.fit(flat, counts, np.arange(len(index)), lengths, np.repeat(labels, lengths),
                            3 * MEASURES * (BINS + 1), 2, rounds, weight=share_of_line)
    share, _, _ = good_share(texts, model)
    x = np.log((share + 1e-3) / (1 - share + 1e-3))
    a, b = 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a * x + b)))
        a -= 0.2 * (((p - labels) * x).mean() + 1e-3 * (a - 1))
        b -= 0.2 * (p - labels).mean()
    model.slope, model.shift = a, b
    return model


def score(docs: DataFrame, text: str, model: Model, with_lines: bool = False,
          keep: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``score``, the probability that a document is good; with ``with_lines``
    also ``line_scores``, one for each line. Columns of these names are replaced.

    Null counts as the empty text, which is one empty line. Repeated rows get equal scores, an
    empty table none. A model that saw one label only gives every text the same score. Whole
    texts of any length, in the stage that reads them.
    """
    added = [("score", T.DoubleType())] + ([("line_scores", T.ArrayType(T.DoubleType()))] if with_lines else [])
    kept = [c for c in keep or docs.columns if c not in dict(added)]
    frame, at = text_beside(docs, text, kept)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lines = [], []
            for _, texts in chunks_of(batch.column(at)):
                if model.weights is None:
                    share, good = np.full(len(texts), 0.5), [np.full(t.count("\n") + 1, 0.5) for t in texts]
                else:
                    share, lengths, each = good_share(texts, model)
                    good = np.split(each, np.cumsum(lengths)[:-1])
                x = model.slope * np.log((share + 1e-3) / (1 - share + 1e-3)) + model.shift
                out += (1 / (1 + np.exp(-x))).tolist()
                lines += good if with_lines else []
            made = [pa.array(out, pa.float64())]
            made += [pa.array([x.tolist() for x in lines], pa.list_(pa.float64()))] if with_lines else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *made], names=[*kept, *dict(added)])

    return frame.mapInArrow(run, schema)
