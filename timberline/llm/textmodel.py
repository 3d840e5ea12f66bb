"""Hashed word and character n-grams of whole texts, and linear models on them.

A text's features are the counts of its words, word pairs and character
3- and 4-grams (of UTF-8 bytes), hashed to ``DIM`` places; each of the two
groups is divided by the square root of its number of n-grams.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import give_back

DIM = 1 << 18
_BITS = 18
FALSE_SHARE = 0.01
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
_SHIFT = np.uint32(32 - _BITS)


def word_places(words: Sequence[bytes]) -> np.ndarray:
    """Places of words and word pairs (lower-case ASCII letters)."""
    h = np.array([zlib.crc32(w) for w in words], np.uint32)
    one = (h * _A) >> _SHIFT
    two = ((h[:-1] * _B ^ h[1:]) * _C) >> _SHIFT
    return np.concatenate([one, two])


def char_places(raw: bytes) -> np.ndarray:
    """Places of the byte 3- and 4-grams."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    four = three[:-1] | b[3:] << np.uint32(24)
    return np.concatenate([((three ^ _C) * _B) >> _SHIFT, (four * _A ^ _B) * _C >> _SHIFT])


def score(weights: np.ndarray, raw: bytes, words: Sequence[bytes], presence: bool = False) -> float:
    """Decision value without intercept; 0 for a text without n-grams."""
    z = 0.0
    for places in (word_places(words), char_places(raw)):
        if len(places):
            z += float(weights[np.unique(places) if presence else places].sum(dtype=np.float64)) / len(places) ** 0.5
    return z


def features(text: str, presence: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and values of one text; with ``presence`` an n-gram counts once however often it stands."""
    raw = text.encode()
    at, value = [], []
    for places in (word_places(raw.lower().split()), char_places(raw)):
        if len(places):
            p, n = np.unique(places, return_counts=True)
            at.append(p)
            value.append((np.ones(len(p)) if presence else n) / len(places) ** 0.5)
    return (np.concatenate(at), np.concatenate(value)) if at else (np.zeros(0, np.uint32), np.zeros(0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _chi_square(at: np.ndarray, grade: np.ndarray, places: int, size: np.ndarray) -> np.ndarray:
    """Chi-square of each place's presence in a text against the text's grade."""
    seen = np.stack([np.bincount(at[grade == g], minlength=places) for g in range(len(size))]).astype(np.float64)
    total, n = seen.sum(axis=0), size.sum()
    expected = np.outer(size / n, total)
    absent = np.outer(size / n, n - total)
    gap = (seen - expected) ** 2
    return (gap / np.maximum(expected, 1e-9)).sum(axis=0) + (gap / np.maximum(absent, 1e-9)).sum(axis=0)


def _tail(x: np.ndarray, freedom: int) -> np.ndarray:
    """P(chi-square >= x) with that many degrees of freedom."""
    h = np.asarray(x, np.float64) / 2
    p, a = (np.array([math.erfc(v) for v in np.sqrt(h)]), 0.5) if freedom % 2 else (np.exp(-h), 1.0)
    while a < freedom / 2:
        p = p + h ** a * np.exp(-h) / math.gamma(a + 1)
        a += 1
    return p


def telling_places(chi_square: np.ndarray, classes: int, false_share: float = FALSE_SHARE) -> np.ndarray:
    """Places that depend on the grade, with at most that share of false ones expected (Benjamini-Hochberg)."""
    p = _tail(chi_square, classes - 1)
    ranked = np.sort(p)
    passed = np.flatnonzero(ranked <= false_share * np.arange(1, len(p) + 1) / max(1, len(p)))
    return p <= ranked[passed[-1]] if len(passed) else np.zeros(len(p), bool)


def fit_cumulative(texts: Sequence[str], grades: np.ndarray, classes: int, epochs: int = 120, decay: float = 0.02,
                   rate: float = 0.3, presence: bool = False, false_share: float = FALSE_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of P(grade >= k) = sigmoid(w x - t_k); two classes are logistic regression.

    Full-batch Adam on the log likelihood with classes weighed alike. N-grams whose presence hardly depends
    on the grade (they are not among ``telling_places``) get no weight; ``decay`` shrinks the others.
    """
    parts = [features(t, presence) for t in texts]
    at = np.concatenate([p for p, _ in parts]).astype(np.int64)
    value = np.concatenate([v for _, v in parts]).astype(np.float64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
    n = len(parts)
    used, at = np.unique(at, return_inverse=True)
    chi_square = _chi_square(at, grades[row], len(used), np.bincount(grades, minlength=classes))
    telling = telling_places(chi_square, classes, false_share)
    keep = telling[at]
    at, value, row = (np.cumsum(telling) - 1)[at[keep]], value[keep], row[keep]
    used = used[telling]
    share = 1.0 / (classes * np.bincount(grades, minlength=classes)[grades])
    w, t0, gaps = np.zeros(len(used)), 0.0, np.zeros(classes - 2)
    state = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(classes - 1), np.zeros(classes - 1)]
    for step in range(1, epochs + 1):
        t = t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.bincount(row, w[at] * value, minlength=n)
        tail = np.hstack([np.ones((n, 1)), sigmoid(z[:, None] - t), np.zeros((n, 1))])
        a, b = tail[np.arange(n), grades], tail[np.arange(n), grades + 1]
        p = np.maximum(a - b, 1e-12)
        gz = -(1 - a - b) * share
        gt = np.zeros(classes + 1)
        np.add.at(gt, grades, a * (1 - a) / p * share)
        np.add.at(gt, grades + 1, -b * (1 - b) / p * share)
        gt = gt[1:-1]
        gw = np.bincount(at, gz[row] * value, minlength=len(used))
        # the first threshold moves all, a gap moves those above it
        above = np.cumsum(gt[::-1])[::-1]
        gs = np.concatenate([[above[0]], above[1:] * np.exp(gaps)])
        for g, i in ((gw, 0), (gs, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
        fix = (1 - 0.99 ** step) ** 0.5 / (1 - 0.9 ** step)
        w -= rate * (fix * state[0] / (np.sqrt(state[1]) + 1e-8) + decay * w)
        move = 0.05 * fix * state[2] / (np.sqrt(state[3]) + 1e-8)
        t0 -= move[0]
        gaps -= move[1:]
    full = np.zeros(DIM, np.float32)
    full[used] = w
    return full, t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def calibrate(z: np.ndarray, hit: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt scaling: P(hit) = sigmoid(slope z + shift), by Newton steps that are halved until the loss falls.

    The slope is pulled lightly to 1, which keeps separable rows finite.
    """
    y = np.where(hit, 1 - 1 / (hit.sum() + 2), 1 / ((~hit).sum() + 2))

    def loss(at: np.ndarray) -> float:
        t = at[0] * z + at[1]
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + 5e-5 * (at[0] - 1) ** 2)

    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(at[0] * z + at[1])
        g, h = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(g * z).sum() + 1e-4 * (at[0] - 1), g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        move, now = np.linalg.solve(hess, grad), loss(at)
        while loss(at - move) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        if np.abs(move).max() <= 1e-9:
            break
        at = at - move
    return float(at[0]), float(at[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, grade, per_grade: int, grades: int, max_chars: int, seed: int) -> DataFrame:
    """``doc_id, grade, text`` of at most ``per_grade`` labelled documents of each grade, by seeded hash.

    The bound holds for any input: documents above ``max_chars`` are not trained on, and a repeated id counts once.
    """
    graded = labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").distinct()
    key = F.xxhash64(F.lit(seed), "doc_id", "grade")
    picked = None
    for g in range(grades):
        part = graded.where(F.col("grade") == g).orderBy(key, "doc_id").limit(per_grade)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))


def fit_in_task(sample: DataFrame, fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> list:
    """Fit on a bounded sample in one task; the rows of ``fit`` come back."""
    def fitted(g: pd.DataFrame) -> pd.DataFrame:
        out = fit(g.sort_values(["doc_id", "grade"]))
        give_back()
        return out
    return sample.groupBy(F.lit(0).alias("_all")).applyInPandas(fitted, schema).collect()
