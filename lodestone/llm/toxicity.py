"""Toxicity by a linear classifier that must not mind which group a sentence names.

A document's score sums its distinct words' scores, a word's the weights of itself and its
affixes. Weights are never negative, so that harmless text cannot outweigh an insult however
long it is, and weights that do not help are held at zero. In training, labelled sentences that name
a group are copied with the name swapped for others, and the change in score is penalised, so
that names of groups gain no weight of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks_of, text_beside
from .crf import ragged_sum

DOCS_PER_LABEL = 1500
CACHE = 300_000
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
# Names of groups that are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "american", "indian", "chinese"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives"), ("deaf", "blind", "disabled", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "athées"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "atheisten"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "ateos"),
)


def parts(word: str) -> list[str]:
    """The word, its first three to six letters, and its last four."""
    return ["=" + word, *["^" + word[:n] for n in range(3, 7) if len(word) > n],
            *(["$" + word[-4:]] if len(word) > 4 else [])]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swapped(text: str, groups: Sequence[Sequence[str]]) -> Iterator[tuple[set[str], set[str]]]:
    """Words of each sentence that names a group, and the same with the name swapped for each
    other of its kind."""
    kind = {term: group for group in groups for term in group}
    for sentence in SENTENCE.split(text):
        words = words_of(sentence)
        for term in sorted(words & kind.keys()):
            for other in kind[term]:
                if other != term:
                    yield words, words - {term} | {other}


@dataclass
class Model:
    numbers: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def word_score(self, word: str) -> float:
        get = self.numbers.get
        return float(sum(self.weights[n] for n in map(get, parts(word)) if n is not None))


def train(sample: Sequence[tuple[int, str]], groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
          swap: float = 4.0, lasso: float = 1e-3, rounds: int = 200,
          rate: float = 0.2) -> Model:
    """Model from (label, text) pairs, label 1 for toxic; both labels weigh alike.

    The loss is logistic, plus ``swap`` times the mean squared change of a sentence's score
    over its swaps, plus ``lasso`` times the sum of the weights' sizes. Proximal steps
    (AdaGrad), so that most weights are exactly zero.
    """
    labels = np.array([int(y) for y, _ in sample], float)
    model = Model()
    if len(set(labels.tolist())) < 2:
        model.bias = 4.0 if len(labels) and labels[0] else -4.0
        return model
    bags = [words_of(t) for _, t in sample]
    pairs = [p for _, t in sample for p in swapped(t, groups)]
    seen = Counter(p for bag in bags for p in {q for w in bag for q in parts(w)})
    model.numbers = {p: i for i, p in enumerate(sorted(p for p, c in seen.items() if c >= 3))}
    kinds: dict[str, int] = {}
    item = [kinds.setdefault(w, len(kinds)) for bag in bags for w in sorted(bag)]
    changed = [(kinds.setdefault(w, len(kinds)), sign) for before, after in pairs
               for sign, side in ((1.0, before - after), (-1.0, after - before)) for w in side]
    found = [[n for n in map(model.numbers.get, parts(w)) if n is not None] for w in kinds]
    counts = np.array([len(f) for f in found])
    flat, owner = np.array([n for f in found for n in f], np.int64), np.repeat(np.arange(len(counts)), counts)
    item, size = np.array(item, np.int64), np.array([len(bag) for bag in bags])
    doc = np.repeat(np.arange(len(bags)), size)
    swap_item = np.array([k for k, _ in changed], np.int64)
    swap_sign = np.array([s for _, s in changed])
    swap_pair = np.repeat(np.arange(len(pairs)), 2)
    balance = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    n = len(model.numbers)
    w, past, bias, bias_past = np.zeros(n), np.zeros(n), 0.0, 0.0
    for _ in range(rounds):
        word = ragged_sum(w[:, None], flat, counts)[:, 0]
        logit = np.bincount(doc, word[item], len(bags)) + bias
        slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * balance
        by_word = np.bincount(item, slope[doc], len(counts))
        if len(pairs):
            change = np.bincount(swap_pair, word[swap_item] * swap_sign, len(pairs))
            by_word += np.bincount(swap_item, 2 * swap / len(pairs) * change[swap_pair] * swap_sign, len(counts))
        grad = np.bincount(flat, by_word[owner], n)
        past += grad ** 2
        step = rate / np.sqrt(past + 1e-9)
        w = np.maximum(0, w - step * (grad + lasso))
        bias_past += slope.sum() ** 2
        bias -= rate * slope.sum() / np.sqrt(bias_past + 1e-9)
    model.weights, model.bias = w, bias
    used = np.flatnonzero(w)
    place = dict(zip(used.tolist(), range(len(used))))
    model.numbers = {p: place[i] for p, i in model.numbers.items() if i in place}
    model.weights = w[used]
    return model


def score(docs: DataFrame, text: str, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``score``, the probability that a document is toxic. A column of that name
    is replaced.

    Null counts as the empty text; both get what the bias says. Repeated rows get equal scores,
    an empty table none. A model that saw one label
    only gives every text the same score. Whole texts, in the stage that reads them; scores of
    words are kept per worker, 300,000 at most, then anew.
    """
    kept = [c for c in keep or docs.columns if c != "score"]
    frame, at = text_beside(docs, text, kept)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for _, texts in chunks_of(batch.column(at)):
                if len(known) > CACHE:
                    known.clear()
                for found in map(words_of, texts):
                    fresh = [w for w in found if w not in known]
                    known.update(zip(fresh, map(model.word_score, fresh)))
                    total = sum(sorted(map(known.__getitem__, found)))
                    out.append(1 / (1 + np.exp(-np.clip(model.bias + total, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(out, pa.float64())],
                                             names=[*kept, "score"])

    return frame.mapInArrow(run, schema)
