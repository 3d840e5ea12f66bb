"""Quality rules: fixed counts of a text, then a calibrated logistic regression on hashed n-grams.

The model is trained on labelled documents (quality 0 or 1): at most
``PER_CLASS`` of each class, by seeded hash; a fifth of them calibrates the
probabilities to the class shares of all labels. It scores every text in Arrow
batches; a text is kept when P(quality) reaches ``THRESHOLD``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import textmodel
from timberline.llm.common import columns, table, tidied, unused

PER_CLASS = 1000
MAX_TRAIN_CHARS = 50_000
THRESHOLD = 0.5
WINDOW = 8

# Fixed values of the base rules.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words (a power of two) that occur at two or more places.

    Exact: window ids are built by doubling, (id, id) -> id, without hashing.
    """
    n, known = len(words), {}
    if n <= window:
        return 0
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    span = 1
    while span < window:
        pair = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        found, ids, count = np.unique(pair, return_inverse=True, return_counts=True)
        if len(found) == len(pair):
            return 0
        span *= 2
    edges = np.zeros(n + 1, np.int64)
    again = count[ids] > 1
    edges[:len(again)] += again
    edges[window:window + len(again)] -= again
    return int((np.cumsum(edges)[:n] > 0).sum())


@dataclass(frozen=True)
class QualityModel:
    """Weights and calibration; ``weights`` None means that the labels hold no two classes: P is 1."""

    weights: np.ndarray | None
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, raw: bytes, words: list[bytes]) -> float:
        if self.weights is None:
            return 1.0
        return float(textmodel.sigmoid(np.array(self.slope * textmodel.score(self.weights, raw, words) + self.shift)))


def _fit(shares: list[float]):
    def fit(g: pd.DataFrame) -> pd.DataFrame:
        grade, texts = g["grade"].to_numpy(np.int64), g["text"].tolist()
        held = g.groupby("grade").cumcount().to_numpy() % 5 == 0  # of each class, however small the sample
        none = pd.DataFrame({"weights": [None], "slope": [1.0], "shift": [0.0]})
        if any(len(np.unique(grade[m])) < 2 for m in (held, ~held)):
            return none
        w, t = textmodel.fit_cumulative([x for x, h in zip(texts, held) if not h], grade[~held], 2)
        z = np.array([textmodel.score(w, (r := x.encode()), r.lower().split()) for x, h in zip(texts, held) if h]) - t[0]
        y = grade[held]
        weight = np.array(shares)[y] / np.bincount(y, minlength=2)[y]
        slope, shift = textmodel.calibrate(z, y == 1, weight)
        return pd.DataFrame({"weights": [w.tobytes()], "slope": [slope], "shift": [shift - slope * t[0]]})
    return fit


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS, seed: int = 11) -> QualityModel:
    """Fit on labelled rows; labels other than 0 and 1 and labels without a document are left out."""
    n = {r["quality"]: r["count"] for r in labels.where("quality IN (0, 1)").groupBy("quality").count().collect()}
    if len(n) < 2:
        return QualityModel(None)
    shares = [n[0] / (n[0] + n[1]), n[1] / (n[0] + n[1])]
    quality = F.when(F.col("quality").isin(0, 1), F.col("quality").cast("int"))
    sample = textmodel.labelled_sample(docs, labels, quality, per_class, 2, max_chars, seed)
    rows = textmodel.fit_in_task(sample, _fit(shares), "weights binary, slope double, shift double")
    if not rows or rows[0]["weights"] is None:
        return QualityModel(None)
    return QualityModel(np.frombuffer(rows[0]["weights"], np.float32), rows[0]["slope"], rows[0]["shift"])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_quality double, kept boolean"


def measure(text: str, model: QualityModel, threshold: float) -> tuple:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    p = model.probability(raw, raw.lower().split())
    return (n, chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeats, failed, p,
            not failed and p >= threshold)


def with_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text: str = "text", name: str = "quality_rules") -> DataFrame:
    """Every row with a struct of counts, ``base_failed``, ``p_quality`` and ``kept``.

    NULL text counts as empty: no words, base rule failed. Repeated rows get equal results. An input column of the
    struct's name is replaced.
    """
    fields = [f.split()[0] for f in RESULT.split(", ")]

    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t or "", model, threshold) for t in texts], columns=fields)

    @F.pandas_udf(RESULT)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidied(measured)(batches)

    return docs.withColumn(name, rules(F.col(f"`{text}`")))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass base rules and model, with their columns."""
    name = unused(docs, "quality_rules")
    return with_quality(docs, train(docs, labels), name=name).where(F.col(f"{name}.kept")).select(*columns(docs))


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, base rule and the model's verdict for all ``documents``."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels"))
    return with_quality(docs, model).select("doc_id", "quality_rules.*")
