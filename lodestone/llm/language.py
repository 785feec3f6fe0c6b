"""Language of words in mixed text by a linear-chain conditional random field.

Words show affixes, letter n-grams and whether a learned lexicon lists them; transitions say
how rarely speakers switch. Forward-backward labels every word, and the words' probabilities
together name a document's language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import crf
from .common import chunks_of, text_beside

LETTERS = re.compile(r"[^\W\d_]+")
DOCS_PER_LANGUAGE = 150
SEGMENT = 512
CACHE = 200_000
GRAMS = 1 << 17
UNKNOWN = "und"


def grams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all words, number for each): n-grams of two and three letters of a
    word between end marks, so that its affixes are among them, and those of four at its ends.
    All letters of a word are read, however long it is.
    """
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    start = np.zeros(len(codes), bool)
    start[np.cumsum(size) - size] = True
    made, owner, value = [], [], codes * np.uint64(0x9E3779B97F4A7C15)
    for n in (2, 3, 4):
        value = value[:-1] * np.uint64(0x100000001B3) + codes[n - 1:]
        inside = word[:len(value)] == word[n - 1:]
        if n == 4:
            inside &= start[:len(value)] | np.r_[start, True][n:n + len(value)]
        at = np.flatnonzero(inside)
        mixed = (value[at] ^ value[at] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        made.append((mixed >> np.uint64(47)).astype(np.int64))
        owner.append(word[at])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(made)[order], np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    """Languages in order, known words and the lexicon (word -> feature), and weights."""

    languages: list[str]
    known: dict[str, int] = field(default_factory=dict)
    lexicon: dict[str, int] = field(default_factory=dict)
    weights: crf.Weights | None = None

    def features(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features of all words, number for each)."""
        flat, counts = grams(words)
        more = [(i, n) for i, w in enumerate(words) if w in self.known
                for n in (self.known[w], self.lexicon.get(w)) if n is not None]
        at = np.fromiter((i for i, _ in more), np.int64, len(more))
        ends = np.cumsum(counts)
        return (np.insert(flat, ends[at], np.fromiter((n for _, n in more), np.int64, len(more))),
                counts + np.bincount(at, minlength=len(words)))


def segments(n: int) -> list[int]:
    """Lengths of the sequences that n words form for fitting: 512 words each, the last what is
    left. Texts are labelled without cuts."""
    return [SEGMENT] * (n // SEGMENT) + ([n % SEGMENT] if n % SEGMENT else [])


def train(sample: Sequence[tuple[str, str]], rounds: int = 30) -> Model:
    """Model from (language, text) pairs; every word of a text counts as of its language."""
    model = Model(sorted({language for language, _ in sample}))
    number = {language: i for i, language in enumerate(model.languages)}
    kinds: dict[str, int] = {}
    item, label, lengths, in_docs = [], [], [], defaultdict(Counter)
    for language, text in sample:
        words = LETTERS.findall(text.lower())
        item += [kinds.setdefault(w, len(kinds)) for w in words]
        label += [number[language]] * len(words)
        lengths += segments(len(words))
        for w in set(words):
            in_docs[w][language] += 1
    if not item:
        return model
    often = sorted(w for w, by in in_docs.items() if sum(by.values()) >= 4)
    model.known = {w: GRAMS + i for i, w in enumerate(often)}
    base = GRAMS + len(often)
    for word in often:
        language, most = in_docs[word].most_common(1)[0]
        if most >= 5 and most >= 0.9 * sum(in_docs[word].values()):
            model.lexicon[word] = base + number[language]
    flat, counts = model.features(list(kinds))
    model.weights = crf.fit(flat, counts, np.array(item), np.array(lengths), np.array(label),
                            base + len(number), len(number), rounds)
    model.weights.emission = model.weights.emission.astype(np.float32)
    return model


class Tagger:
    """Labels words with a model. Scores of words are kept, 200,000 at most, then anew."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def learn(self, words: list[str]) -> None:
        made = crf.ragged_sum(self.model.weights.emission, *self.model.features(words))
        self.ids.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.scores = np.concatenate([self.scores, made])

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """Per text, its words' probabilities of each language."""
        words = [LETTERS.findall(t.lower()) for t in texts]
        flat = [w for ws in words for w in ws]
        if len(self.ids) > CACHE:
            self.ids, self.scores = {}, self.scores[:0]
        fresh = list(set(flat).difference(self.ids))
        if fresh:
            self.learn(fresh)
        item = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(ws) for ws in words if ws], np.int64)
        gamma = crf.long_marginals(self.scores[item], lengths, self.model.weights, SEGMENT)
        return np.split(gamma, np.cumsum([len(ws) for ws in words])[:-1])


def runs(gamma: np.ndarray, languages: list[str]) -> list[dict]:
    """Stretches of words with one most likely language: its name, first word and length."""
    if not len(gamma):
        return []
    best = gamma.argmax(axis=1)
    first = np.flatnonzero(np.r_[True, np.diff(best) != 0])
    return [{"lang": languages[best[i]], "first": int(i), "words": int(n)}
            for i, n in zip(first, np.diff(np.r_[first, len(best)]))]


def identify(docs: DataFrame, text: str, model: Model, with_runs: bool = False,
             keep: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``lang_pred`` and ``score``; with ``with_runs`` also ``lang_runs``, the
    stretches of each language in word positions. Columns of these names are replaced.

    The language is the one that the most words are expected to be in, ties to the first in
    order, and the score its share. Null texts, texts without a letter, and any text under a
    model that learned nothing get ``und`` and 0. Repeated rows get equal results, an empty table
    none. Whole texts, in the stage that reads them: every letter of a word counts, and what is
    known of a word reaches all others of its text.
    """
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
    if with_runs:
        kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()),
                             T.StructField("words", T.LongType())])
        added.append(("lang_runs", T.ArrayType(kind)))
    kept = [c for c in keep or docs.columns if c not in dict(added)]
    frame, at = text_beside(docs, text, kept)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in added])
    arrow = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            best, score, spans = [], [], []
            for _, texts in chunks_of(batch.column(at)):
                tagged = tagger.tag(texts) if model.weights else [np.zeros((0, 1))] * len(texts)
                for gamma in tagged:
                    share = gamma.mean(axis=0) if len(gamma) else np.zeros(1)
                    best.append(model.languages[int(share.argmax())] if len(gamma) else UNKNOWN)
                    score.append(min(1.0, float(share.max())))
                    if with_runs:
                        spans.append(runs(gamma, model.languages))
            made = [pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], *made, *([pa.array(spans, arrow)] if with_runs else [])],
                names=[*kept, *dict(added)])

    return frame.mapInArrow(run, schema)
