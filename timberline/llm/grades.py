"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w x - t_k) with shared hashed-text weights and ordered
thresholds. It gives the expected grade and the tail probability of the top
grade, calibrated on held-out rows; documents are selected by that tail, at a
cut chosen on the held-out rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import textmodel
from timberline.llm.common import table

GRADES = 3
PER_GRADE = 1500
MAX_TRAIN_CHARS = 50_000
THRESHOLD = 0.5
LEAST_KEPT = 0.97  # share of the held-out top grade that the cut has to keep


def graded(quality: Column, toxic: Column) -> Column:
    """Rating of a labelled row: 0 toxic, 1 low quality, 2 good and clean; NULL without both labels."""
    return (F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, 0).when(quality == 0, 1)
            .when((quality == 1) & (toxic == 0), 2)).cast("int")


@dataclass(frozen=True)
class GradeModel:
    """``weights`` None: fewer than two grades are labelled, every text gets the top grade."""

    weights: np.ndarray | None
    thresholds: tuple[float, ...] = ()
    slope: float = 1.0
    shift: float = 0.0
    cut: float = THRESHOLD

    def predict(self, text: str, top: int) -> tuple[float, float]:
        """Expected grade and calibrated P(top grade)."""
        if self.weights is None:
            return float(top), 1.0
        raw = text.encode()
        z = textmodel.score(self.weights, raw, raw.lower().split(), presence=True)
        tail = textmodel.sigmoid(z - np.array(self.thresholds))
        return float(tail.sum()), float(textmodel.sigmoid(np.array(self.slope * z + self.shift)))


def best_cut(p: np.ndarray, grade: np.ndarray, grades: int, least: float = LEAST_KEPT) -> float:
    """The cut of P(top) that parts the top grade best from the lower grade it parts worst, keeping ``least`` of the top."""
    at = np.unique(p)
    cuts = np.concatenate([[0.0], (at[1:] + at[:-1]) / 2])
    kept = [(p[grade == g][:, None] >= cuts).mean(axis=0) for g in range(grades)]
    return float(cuts[np.where(kept[-1] >= least, kept[-1] - np.max(kept[:-1], axis=0), -np.inf).argmax()])


def _fit(shares: list[float], grades: int):
    def fit(g: pd.DataFrame) -> pd.DataFrame:
        grade, texts = g["grade"].to_numpy(np.int64), g["text"].tolist()
        held = g.groupby("grade").cumcount().to_numpy() % 5 == 0  # of each grade, however small the sample
        if any(len(np.unique(grade[m])) < grades for m in (held, ~held)):
            return pd.DataFrame({"weights": [None], "thresholds": [None], "slope": [1.0], "shift": [0.0], "cut": [THRESHOLD]})
        w, t = textmodel.fit_cumulative([x for x, h in zip(texts, held) if not h], grade[~held], grades, presence=True)
        z = np.array([textmodel.score(w, (r := x.encode()), r.lower().split(), presence=True) for x, h in zip(texts, held) if h])
        y = grade[held]
        weight = np.array(shares)[y] / np.bincount(y, minlength=grades)[y]
        slope, shift = textmodel.calibrate(z - t[-1], y == grades - 1, weight)
        cut = best_cut(textmodel.sigmoid(slope * (z - t[-1]) + shift), y, grades)
        return pd.DataFrame({"weights": [w.tobytes()], "thresholds": [list(map(float, t))], "slope": [slope], "shift": [shift - slope * t[-1]], "cut": [cut]})
    return fit


def train(docs: DataFrame, rated: DataFrame, grade: Column, grades: int = GRADES, per_grade: int = PER_GRADE,
          max_chars: int = MAX_TRAIN_CHARS, seed: int = 23) -> GradeModel:
    """Fit on rated rows (``doc_id`` and ``grade`` from 0); at most ``per_grade`` documents of each grade."""
    n = {r["grade"]: r["count"] for r in rated.select(grade.alias("grade")).where(F.col("grade").between(0, grades - 1))
         .groupBy("grade").count().collect()}
    if len(n) < grades:
        return GradeModel(None)
    shares = [n[g] / sum(n.values()) for g in range(grades)]
    sample = textmodel.labelled_sample(docs, rated, grade, per_grade, grades, max_chars, seed)
    rows = textmodel.fit_in_task(sample, _fit(shares, grades), "weights binary, thresholds array<double>, slope double, shift double, cut double")
    if not rows or rows[0]["weights"] is None:
        return GradeModel(None)
    r = rows[0]
    return GradeModel(np.frombuffer(r["weights"], np.float32), tuple(r["thresholds"]), r["slope"], r["shift"], r["cut"])


def with_grade(docs: DataFrame, model: GradeModel, threshold: float | None = None, grades: int = GRADES, text: str = "text",
               name: str = "grade") -> DataFrame:
    """Every row with a struct ``expected_grade, p_top, kept``; without a threshold the model's cut holds. NULL text counts as empty."""
    threshold = model.cut if threshold is None else threshold

    @F.pandas_udf("expected_grade double, p_top double, kept boolean")
    def rate(texts: pd.Series) -> pd.DataFrame:
        out = np.array([model.predict(t or "", grades - 1) for t in texts]).reshape(-1, 2)
        return pd.DataFrame({"expected_grade": out[:, 0], "p_top": out[:, 1], "kept": out[:, 1] >= threshold})

    return docs.withColumn(name, rate(F.col(f"`{text}`")))


def op9_quality_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Expected grade, tail probability and selection of all ``documents``."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    model = train(docs, labels, graded(F.col("quality"), F.col("toxic")))
    return with_grade(docs, model).select("doc_id", "grade.*")
