"""Linear-chain conditional random fields over many sequences at once, in numpy.

Positions of all sequences lie one after another. A position's emission scores are sums of
feature weights; a transition matrix scores neighbouring labels. Steps run over time, each for
all sequences that are still going, so the cost of a step is shared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Weights:
    emission: np.ndarray  # features x labels
    transition: np.ndarray  # labels x labels
    start: np.ndarray


RUNS = 1 << 12


def ragged_sum(values: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values[flat]`` over runs of the given lengths; an empty run sums to 0. So many
    runs at a time, as ``values[flat]`` is many times the result."""
    out = np.zeros((len(counts), values.shape[1]), values.dtype)
    some = np.flatnonzero(counts)
    starts, ends = (np.cumsum(counts) - counts)[some], np.cumsum(counts)[some]
    for at in range(0, len(some), RUNS):
        part = slice(at, at + RUNS)
        first = starts[at]
        out[some[part]] = np.add.reduceat(values[flat[first:ends[part][-1]]], starts[part] - first, axis=0)
    return out


def marginals(emission: np.ndarray, lengths: np.ndarray, w: Weights, pairs: bool = False,
              enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(label probabilities of each position, expected transitions) by forward-backward.

    ``lengths`` are above 0. Messages are normalised at each step, so nothing underflows.
    ``enter`` and ``leave`` are the messages that come to each sequence from outside; without
    them sequences begin with the start weights and end freely.
    """
    labels = emission.shape[1]
    if not len(lengths):
        return np.zeros((0, labels)), np.zeros((labels, labels)) if pairs else None
    order = np.argsort(-lengths, kind="stable")
    starts, lens = (np.cumsum(lengths) - lengths)[order], lengths[order]
    going = np.searchsorted(-lens, -np.arange(lens[0]), "left")
    e = emission - emission.max(axis=1, keepdims=True)
    np.exp(e, out=e)
    step = np.exp(w.transition - w.transition.max()).astype(e.dtype)
    alpha = np.empty_like(e)
    a = e[starts] * (np.exp(w.start - w.start.max()) if enter is None else enter[order]).astype(e.dtype)
    for t in range(lens[0]):
        at = starts[:going[t]] + t
        if t:
            a = (a[:going[t]] @ step) * e[at]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[at] = a
    out = alpha  # a step back reads what lies before it only
    b = np.ones((len(lens), labels), e.dtype) if leave is None else leave[order].astype(e.dtype)
    expected = np.zeros((labels, labels))
    for t in range(lens[0] - 1, -1, -1):
        n = going[t]
        at = starts[:n] + t
        gamma = alpha[at] * b[:n]
        out[at] = gamma / gamma.sum(axis=1, keepdims=True)
        ahead = e[at] * b[:n]
        if pairs and t:
            joint = alpha[at - 1][:, :, None] * step * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = ahead @ step.T
        b[:n] = back / back.sum(axis=1, keepdims=True)
    return out, expected if pairs else None


def transfers(emission: np.ndarray, lengths: np.ndarray, w: Weights) -> np.ndarray:
    """Per sequence the matrix that takes the message entering it to its last position, and, read
    the other way, the message leaving it to its first. Scaled to a largest entry of 1."""
    labels = emission.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts, lens = (np.cumsum(lengths) - lengths)[order], lengths[order]
    going = np.searchsorted(-lens, -np.arange(lens[0]), "left")
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    step = np.exp(w.transition - w.transition.max()).astype(e.dtype)
    m = np.eye(labels, dtype=e.dtype) * e[starts][:, None, :]
    for t in range(1, lens[0]):
        n = going[t]
        made = (m[:n] @ step) * e[starts[:n] + t][:, None, :]
        m[:n] = made / made.max(axis=(1, 2), keepdims=True)
    out = np.empty_like(m)
    out[order] = m
    return out


def long_marginals(emission: np.ndarray, lengths: np.ndarray, w: Weights, piece: int) -> np.ndarray:
    """``marginals`` of sequences of any length in about ``piece`` steps: long ones are cut, the
    messages that cross the cuts are found first, and the pieces then run side by side. The same
    numbers as without cuts, up to rounding."""
    if not len(lengths) or lengths.max() <= piece:
        return marginals(emission, lengths, w)[0]
    parts = -(-lengths // piece)
    first = np.cumsum(parts) - parts
    size = np.full(int(parts.sum()), piece, np.int64)
    size[first + parts - 1] = lengths - (parts - 1) * piece
    step, across = np.exp(w.transition - w.transition.max()), transfers(emission, size, w).astype(np.float64)
    enter, leave = (np.ones((len(size), len(w.start))) for _ in range(2))
    enter[first] = np.exp(w.start - w.start.max())
    many = np.argsort(-parts, kind="stable")
    cuts = [first[many[:n]] + t for t in range(1, int(parts.max()))
            for n in [np.searchsorted(-parts[many], -t, "left")]]  # of sequences with more than t pieces
    for at in cuts:
        come = (enter[at - 1][:, None, :] @ across[at - 1])[:, 0] @ step
        enter[at] = come / come.max(axis=1, keepdims=True)
    for at in cuts[::-1]:
        back = (across[at] @ leave[at][:, :, None])[:, :, 0] @ step.T
        leave[at - 1] = back / back.max(axis=1, keepdims=True)
    return marginals(emission, size, w, enter=enter, leave=leave)[0]


def fit(flat: np.ndarray, counts: np.ndarray, item: np.ndarray, lengths: np.ndarray,
        label: np.ndarray, features: int, labels: int, rounds: int = 50, rate: float = 0.1,
        ridge: float = 1e-4, weight: np.ndarray | None = None) -> Weights:
    """Weights of the largest penalised likelihood, by gradient steps (Adam).

    Items (``counts[i]`` features of ``flat`` each) are shared by positions: position p shows
    item ``item[p]`` and has label ``label[p]``. ``weight`` weighs positions.
    """
    w = [np.zeros((features, labels)), np.zeros((labels, labels)), np.zeros(labels)]
    weight = np.ones(len(label)) if weight is None else weight
    inside = np.ones(len(label), bool)
    first = np.cumsum(lengths) - lengths
    inside[first] = False
    seen = np.zeros((labels, labels))
    at = np.flatnonzero(inside)
    np.add.at(seen, (label[at - 1], label[at]), 1)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in w]
    n, owner = weight.sum(), np.repeat(np.arange(len(counts)), counts)
    for turn in range(1, rounds + 1):
        slope, expected = marginals(ragged_sum(w[0], flat, counts)[item], lengths, Weights(*w), pairs=True)
        slope[np.arange(len(label)), label] -= 1
        slope *= weight[:, None]
        by_item = np.stack([np.bincount(item, slope[:, k], len(counts)) for k in range(labels)], 1)
        grads = [np.stack([np.bincount(flat, by_item[owner, k], features) for k in range(labels)], 1) / n
                 + ridge * w[0], (expected - seen) / n + ridge * w[1], slope[first].sum(axis=0) / n]
        for x, g, (m, v) in zip(w, grads, moments):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
    return Weights(*w)
