"""Character n-gram models in sorted hash arrays.

An n-gram is the 64-bit polynomial hash of its characters.  A model keeps, per
order, the sorted hashes of its n-grams with the part of the probability that
order gives them, and the sorted hashes of its contexts with the weight that goes
on to the next shorter context; a look-up is a binary search.  A batch of texts is
scored over its distinct n-grams, which are few, and summed per text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

U = np.uint64
_P = 0x9E3779B97F4A7C15
BEGIN = 0x110000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
        x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
        return x ^ (x >> U(33))


def characters(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, each text after ``order`` - 1 signs of its beginning, and where each text begins (signs included)."""
    lead = "\x00" * (order - 1)
    joined = np.frombuffer("".join(lead + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    at = np.cumsum([0, *(len(t) + order - 1 for t in texts)])
    for i in range(order - 1):
        joined[np.minimum(at[:-1] + i, max(0, len(joined) - 1))] = BEGIN
    return joined, at


def gram_keys(symbols: np.ndarray, order: int) -> list[np.ndarray]:
    """keys[n - 1][i]: the hash of the n-gram that ends at i (for i < n - 1, of what is there)."""
    s = _mix(symbols.astype(U) + U(1))
    out = [s]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            key = out[-1].copy()
            key[n - 1 :] += s[: len(s) - n + 1] * U(pow(_P, n - 1, 1 << 64))
            out.append(key)
    return out


def _lookup(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    if not len(sorted_keys):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], missing)


@dataclass
class CharModel:
    order: int
    floor: float
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def probabilities(self, keys: list[np.ndarray]) -> np.ndarray:
        """P(last character | the others), from the keys of the n-grams of every order that end there."""
        p = np.full(len(keys[0]), self.floor)
        for n in range(self.order):
            context = keys[n] - keys[0]
            p = _lookup(*self.grams[n], keys[n], 0.0) + _lookup(*self.contexts[n], context, 1.0) * p
        return p


def _counts(texts: list[str], order: int):
    """Per order: distinct n-grams' keys, the keys of their contexts and of themselves without the first character, and counts."""
    symbols, at = characters(texts, order)
    keys = gram_keys(symbols, order)
    real = symbols != BEGIN
    out = []
    for n in range(order):
        key, pick, count = np.unique(keys[n][real], return_index=True, return_counts=True)
        where = np.flatnonzero(real)[pick]
        out.append((key, (keys[n] - keys[0])[where], keys[n - 1][where] if n else None, count.astype(np.float64)))
    return out


def kneser_ney(texts: list[str], order: int) -> CharModel:
    """Interpolated Kneser-Ney: one discount an order; shorter orders count the distinct characters before an n-gram."""
    raw = _counts(texts, order)
    counts = [raw[n][3] for n in range(order)]
    for n in range(order - 1):  # how many longer n-grams end in this one
        ends, number = np.unique(raw[n + 1][2], return_counts=True)
        counts[n] = np.maximum(_lookup(ends, number.astype(np.float64), raw[n][0], 1.0), 1.0)
    grams, contexts = [], []
    for n in range(order):
        key, context, _, _ = raw[n]
        c = counts[n]
        ones, twos = float((c == 1).sum()), float((c == 2).sum())
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        own, of, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(of, c) if len(c) else np.zeros(0)
        grams.append((key, np.maximum(c - discount, 0) / total[of] if len(c) else c))
        contexts.append((own, discount * kinds / total if len(c) else total))
    return CharModel(order, 1.0 / (len(raw[0][0]) + 1), grams, contexts)


def variable_order(texts: list[str], order: int, least: int = 2) -> CharModel:
    """A Markov model of variable order, smoothed as Witten and Bell do: a context is kept only if it was met ``least`` times, else the next shorter one speaks."""
    raw = _counts(texts, order)
    grams, contexts = [], []
    for n in range(order):
        key, context, _, c = raw[n]
        own, of, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(of, c) if len(c) else np.zeros(0)
        keep = total >= (least if n else 1)
        grams.append((key[keep[of]], (c / (total[of] + kinds[of]))[keep[of]]) if len(c) else (key, c))
        contexts.append((own[keep], (kinds / (total + kinds))[keep]) if len(c) else (own, total))
    return CharModel(order, 1.0 / (len(raw[0][0]) + 1), grams, contexts)


def log_probabilities(models: list[CharModel], texts: list[str], step: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(natural log of each model's probability of each text, characters of each text)."""
    out = np.zeros((len(texts), len(models)))
    size = np.array([len(t) for t in texts], np.int64)
    if not models or not len(texts):
        return out, size
    order = max(m.order for m in models)
    begin = 0
    while begin < len(texts):
        end, held = begin, 0
        while end < len(texts) and (end == begin or held + len(texts[end]) <= step):
            held += len(texts[end])
            end += 1
        if end == begin + 1 and held > step:  # one very long text: by overlapping pieces
            text, lead = texts[begin], order - 1
            for a in range(0, held, step):
                out[begin] += _score(models, [text[max(0, a - lead) : a + step]], order, min(a, lead))[0]
        else:
            out[begin:end] = _score(models, texts[begin:end], order, 0)
        begin = end
    return out, size


def _score(models, texts, order, known: int) -> np.ndarray:
    """known: so many of the only text's first characters are context."""
    symbols, at = characters(texts, order)
    keys = gram_keys(symbols, order)
    real = symbols != BEGIN
    real[order - 1 : order - 1 + known] = False
    where = np.flatnonzero(real)
    out = np.zeros((len(texts), len(models)))
    if not len(where):
        return out
    code, distinct = pd.factorize(keys[-1][where])
    pick = np.empty(len(distinct), np.int64)
    pick[code] = where
    few = [k[pick] for k in keys]
    row = np.searchsorted(where, at)
    some = np.flatnonzero(np.diff(row) > 0)
    for j, m in enumerate(models):
        value = np.log(m.probabilities(few[: m.order]))
        out[some, j] = np.add.reduceat(value[code], row[:-1][some])
    return out
