"""Row-local derived columns: formulas, arithmetic, text and dates.

Only a formula with whole-column statistics reads data, once, for its constants.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.core import clean_double, one_row
from timberline.functions.conditions import condition, holds

# Result types a formula column may be cast to.
RESULT_TYPES = {"float": "double", "int": "bigint", "str": "string", "category": "string"}


def formula(sql: str, result: str = "float") -> Column:
    """A Spark SQL expression cast to the result type; bad casts give NULL."""
    if result not in RESULT_TYPES:
        raise ValueError(f"unknown result type {result!r}")
    return F.expr(sql).try_cast(RESULT_TYPES[result])


# Whole-column statistics a formula may use.
COLUMN_STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "sum": F.sum, "min": F.min, "max": F.max}


def formula_column(df: DataFrame, sql: str, name: str, result: str = "float",
                   stats: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Add a formula column.

    ``stats`` binds names in the formula to whole-column statistics, for
    example ``{"m": ("mean", "price")}``; they are read in one aggregation and
    enter the plan as constants.
    """
    if not stats:
        return df.withColumn(name, formula(sql, result))
    values = one_row(df, {k: COLUMN_STATISTICS[kind](clean_double(df, c)) for k, (kind, c) in stats.items()})
    bound = df.withColumns({k: F.lit(v).cast("double") for k, v in values.items()})
    return bound.withColumn(name, formula(sql, result)).drop(*values)


def row_mean(*cols: Column) -> Column:
    """Mean over the non-null values of a row."""
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    filled = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.try_divide(filled, present)


def derive_if(df: DataFrame, column: str, op: str, value, then: Column, other: Column) -> Column:
    return F.when(condition(df, column, op, value), then).otherwise(other)


def ratio(a: Column, b: Column) -> Column:
    """a / b; a zero denominator gives NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def difference(a: Column, b: Column) -> Column:
    return a - b


def add_up(*cols: Column, skipna: bool = True) -> Column:
    """Sum of columns; ``skipna`` counts NULL as 0, otherwise NULL propagates."""
    parts = [F.coalesce(c, F.lit(0)) for c in cols] if skipna else list(cols)
    return reduce(lambda a, b: a + b, parts)


def interaction(df: DataFrame, cols: Sequence[str], kind: str = "multiply") -> Column:
    """Combine two or more numeric columns from left to right."""
    if len(cols) < 2:
        raise ValueError("an interaction needs at least two columns")
    steps = {"multiply": lambda a, b: a * b, "add": lambda a, b: a + b,
             "subtract": lambda a, b: a - b, "divide": F.try_divide}
    if kind not in steps:
        raise ValueError(f"unknown interaction {kind!r}")
    return reduce(steps[kind], [clean_double(df, c) for c in cols])


def binary_flag(df: DataFrame, column: str, op: str, value=None) -> Column:
    """1 where the condition holds, else 0."""
    return holds(condition(df, column, op, value)).cast("int")


def math_transform(x: Column, kind: str) -> Column:
    x = x.cast("double")
    forms = {
        "square": lambda: x * x,
        "abs": lambda: F.abs(x),
        "exp": lambda: F.exp(x),
        "reciprocal": lambda: F.try_divide(F.lit(1.0), x),
        "sqrt_abs": lambda: F.sqrt(F.abs(x)),
        "log_null_zero": lambda: F.ln(F.nullif(x, F.lit(0.0))),
        "log1p_clip": lambda: F.log1p(F.greatest(x, F.lit(0.0))),
        "log_plus1": lambda: F.ln(x + F.lit(1.0)),
    }
    if kind not in forms:
        raise ValueError(f"unknown transform {kind!r}")
    return forms[kind]()


def text_transform(s: Column, kind: str) -> Column:
    """length, word_count, upper, lower, title, extract_number, strip_punctuation.

    ``title`` capitalises after blanks only.
    """
    number = F.regexp_extract(s, r"(\d+\.?\d*)", 1)
    forms = {
        "length": lambda: F.length(s),
        "word_count": lambda: F.size(F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0))),
        "upper": lambda: F.upper(s),
        "lower": lambda: F.lower(s),
        "title": lambda: F.initcap(s),
        "extract_number": lambda: F.nullif(number, F.lit("")).try_cast("double"),
        "strip_punctuation": lambda: F.regexp_replace(s, r"(?U)[^\w\s]", ""),
    }
    if kind not in forms:
        raise ValueError(f"unknown text transform {kind!r}")
    return forms[kind]()


def date_transform(ts: Column, kind: str, ref: str | None = None) -> Column:
    """Calendar parts, whole days since ``ref``, age in years, weekend, 25 December."""
    def days() -> Column:
        if ref is None:
            raise ValueError(f"{kind} needs a reference date")
        micros = F.unix_micros(F.lit(ref).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
        return F.floor(micros / F.lit(86_400_000_000.0)).cast("int")

    forms = {
        "year": lambda: F.year(ts),
        "month": lambda: F.month(ts),
        "day": lambda: F.dayofmonth(ts),
        "weekday": lambda: F.weekday(ts),
        "quarter": lambda: F.quarter(ts),
        "days_since": days,
        "age_years": lambda: days() / F.lit(365.25),
        "is_weekend": lambda: (F.weekday(ts) >= 5).cast("int"),
        "is_christmas": lambda: ((F.month(ts) == 12) & (F.dayofmonth(ts) == 25)).cast("int"),
    }
    if kind not in forms:
        raise ValueError(f"unknown date transform {kind!r}")
    return forms[kind]()
