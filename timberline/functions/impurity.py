"""Impurity criteria over class-count columns, and the same on driver numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted criterion names and the measure each one stands for.
CRITERIA = {
    "gini": "gini",
    "entropy": "entropy",
    "information_gain": "entropy",
    "misclassification": "misclassification",
    "log_loss": "log_loss",
    "deviance": "log_loss",
}

# Decimal places at which two gains count as equal when the best one is chosen.
GAIN_DIGITS = 12


def measure(criterion: str) -> str:
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}; have {sorted(CRITERIA)}")
    return CRITERIA[criterion]


def total(counts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts)


def impurity(counts: Sequence[Column], criterion: str = "gini") -> Column:
    """Impurity of a group given one count column per class; an empty group has 0."""
    kind = measure(criterion)
    n = total(counts).cast("double")
    shares = [c / n for c in counts]
    if kind == "gini":
        value = F.lit(1.0) - reduce(lambda a, b: a + b, [p * p for p in shares])
    elif kind == "misclassification":
        value = F.lit(1.0) - (F.greatest(*shares) if len(shares) > 1 else shares[0])
    else:
        log = F.log2 if kind == "entropy" else F.ln
        value = reduce(lambda a, b: a + b,
                       [F.when(c > 0, -p * log(p)).otherwise(F.lit(0.0)) for c, p in zip(counts, shares)])
    return F.when(n > 0, value).otherwise(F.lit(0.0))


def mass_sql(counts: Sequence[str], criterion: str = "gini") -> str:
    """Group size times impurity as Spark SQL over double counts (NULL for an empty group in gini).

    Split search evaluates this for every candidate, so the expression is kept
    short; as text it reaches the JVM in one call.
    """
    kind = measure(criterion)
    n = "(" + " + ".join(counts) + ")"
    if kind == "gini":
        return f"({n} - try_divide({' + '.join(f'{c} * {c}' for c in counts)}, {n}))"
    if kind == "misclassification":
        return f"({n} - greatest({', '.join([*counts, '0D'])}))"
    log = "log2" if kind == "entropy" else "ln"
    # log(0) is NULL and stands for 0 log 0 = 0
    parts = " - ".join(f"coalesce({c} * {log}({c}), 0D)" for c in counts)
    return f"(coalesce({n} * {log}({n}), 0D) - {parts})"


def gain_sql(left: Sequence[str], right: Sequence[str], criterion: str = "gini") -> str:
    """Parent impurity minus the weighted impurity of two children, as Spark SQL over doubles."""
    both = [f"({a} + {b})" for a, b in zip(left, right)]
    return (f"try_divide({mass_sql(both, criterion)} - {mass_sql(left, criterion)} - {mass_sql(right, criterion)}, "
            f"{' + '.join(both)})")


def impurity_of(counts: Sequence[float], criterion: str = "gini") -> float:
    """The same measure on numbers held by the driver (node rows)."""
    kind = measure(criterion)
    n = float(sum(counts))
    if n <= 0:
        return 0.0
    shares = [c / n for c in counts if c > 0]
    if kind == "gini":
        return 1.0 - sum(p * p for p in shares)
    if kind == "misclassification":
        return 1.0 - max(shares)
    log = math.log2 if kind == "entropy" else math.log
    return -sum(p * log(p) for p in shares)
