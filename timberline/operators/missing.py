"""Missing values: dropping, filling, reporting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.core import clean, clean_double, field_type, is_numeric, long_stats, numeric_columns, one_row, scalar_columns
from timberline.functions.conditions import condition
from timberline.operators.ordering import exact_quantiles

MISSING = "Missing"  # fixed value: label of the null category


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    for c in cols or scalar_columns(df):
        df = df.where(condition(df, c, "is_not_null"))
    return df


def _fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(clean(df, c), F.lit(v).cast(field_type(df, c)))
        for c, v in values.items() if v is not None})


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill each column with its own constant, cast to the column's type."""
    return _fill(df, values)


def fill_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = numeric_columns(df, cols)
    means = one_row(df, {c: F.avg(clean_double(df, c)) for c in cols})
    return df.withColumns({c: F.coalesce(clean_double(df, c), F.lit(m)) for c, m in means.items() if m is not None})


def fill_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = numeric_columns(df, cols)
    medians = exact_quantiles(df, {c: (0.5,) for c in cols})
    return df.withColumns({c: F.coalesce(clean_double(df, c), F.lit(m[0]))
                           for c, m in medians.items() if m[0] is not None})


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest on ties.

    All columns share one aggregation by value (combined map-side) and one top-1 per column; a second, one-row job
    gives the values their types back.
    """
    cols = list(cols)
    if not cols:
        return {}
    numbers = {c: clean_double(df, c) if is_numeric(df, c) else F.lit(None).cast("double") for c in cols}
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), clean(df, c).cast("string").alias("text"), x.alias("number"))
                      for c, x in numbers.items()])
    counts = df.select(F.inline(pairs)).where("text IS NOT NULL").groupBy("feature", "text", "number").count()
    top = counts.groupBy("feature").agg(F.min_by("text", F.struct(-F.col("count"), "number", "text")).alias("text"))
    texts = {r["feature"]: r["text"] for r in top.collect()}
    typed = [F.lit(texts.get(c)).cast(df.schema[c].dataType).alias(f"m{i}") for i, c in enumerate(cols)]
    row = df.sparkSession.range(1).select(*typed).first()
    return {c: row[i] for i, c in enumerate(cols)}


def fill_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _fill(df, modes(df, cols))


LEARNED = ("mean", "median", "zero", "mode")  # policies whose fill values come from the rows


def fill_values(df: DataFrame, cols: Sequence[str], policy: str) -> dict[str, object]:
    """The value each column is filled with under a policy of ``LEARNED``; numeric columns but for ``mode`` as doubles."""
    if policy not in LEARNED:
        raise ValueError(f"unknown missing policy {policy!r}")
    numeric = [] if policy == "mode" else numeric_columns(df, cols)
    out: dict[str, object] = {}
    if policy == "mean" and numeric:
        out = one_row(df, {c: F.avg(clean_double(df, c)) for c in numeric})
    elif policy == "median" and numeric:
        out = {c: q[0] for c, q in exact_quantiles(df, {c: (0.5,) for c in numeric}).items()}
    elif policy == "zero":
        out = dict.fromkeys(numeric, 0)
    return {**out, **modes(df, [c for c in cols if c not in numeric])}


def fill_with(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill columns with ``fill_values`` of these or of other rows."""
    doubles = {c: v for c, v in values.items() if isinstance(v, float) and is_numeric(df, c)}
    df = df.withColumns({c: F.coalesce(clean_double(df, c), F.lit(v)) for c, v in doubles.items()})
    return _fill(df, {c: v for c, v in values.items() if c not in doubles})


def impute(df: DataFrame, cols: Sequence[str], policy: str = "ignore") -> DataFrame:
    """Policy for model features: ignore, drop, mean, median, zero or mode.

    Mean, median and zero apply to numeric columns; the others get the mode.
    """
    if policy == "ignore":
        return df
    if policy == "drop":
        return drop_missing(df, cols)
    return fill_with(df, fill_values(df, cols, policy))


def missing_as_category(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(clean(df, c).cast("string"), F.lit(MISSING)) for c in cols})


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column: count and percent."""
    cols = list(cols or scalar_columns(df))
    stats = long_stats(df, {c: {
        "missing": F.count_if(clean(df, c).isNull()),
        "missing_pct": F.try_divide(F.count_if(clean(df, c).isNull()) * F.lit(100.0), F.count(F.lit(1))),
    } for c in cols})
    return stats


def missing_change(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing cells per column before and after a cleaning step."""
    b = missing_report(before, cols).select("feature", F.col("missing").alias("missing_before"))
    a = missing_report(after, cols).select("feature", F.col("missing").alias("missing_after"))
    return b.join(F.broadcast(a), "feature").withColumn(
        "handled", F.col("missing_before") - F.col("missing_after"))
