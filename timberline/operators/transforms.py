"""Transforms that need whole-column statistics: scaling, ranks, encodings, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.core import clean, clean_double, frozen, one_row
from timberline.functions.scalar import math_transform
from timberline.operators.ordering import (
    average_rank, bucket_of, exact_quantiles, global_index, lookup, small)


def log_transform(df: DataFrame, col: str, name: str, mode: str = "offset", base: float | None = None) -> DataFrame:
    """Logarithm with a rule for values <= 0.

    ``offset``: add |min| + 1 when the minimum is <= 0; ``plus1``: log(x + 1);
    ``log1p_clip``: log1p of x clipped at 0; ``null_zero``: 0 becomes NULL.
    """
    x = clean_double(df, col)
    if mode == "offset":
        low = one_row(df, {"m": F.min(x)})["m"]
        shifted = x + F.lit(abs(low) + 1.0) if low is not None and low <= 0 else x
        value = F.ln(shifted) if base is None else F.log(float(base), shifted)
    else:
        kinds = {"plus1": "log_plus1", "log1p_clip": "log1p_clip", "null_zero": "log_null_zero"}
        if mode not in kinds:
            raise ValueError(f"unknown log mode {mode!r}")
        value = math_transform(x, kinds[mode])
    return df.withColumn(name, value)


def sqrt_transform(df: DataFrame, col: str, name: str, mode: str = "offset") -> DataFrame:
    """Square root; ``offset`` adds |min| when negative, ``abs`` takes |x|."""
    x = clean_double(df, col)
    if mode == "abs":
        return df.withColumn(name, math_transform(x, "sqrt_abs"))
    if mode != "offset":
        raise ValueError(f"unknown sqrt mode {mode!r}")
    low = one_row(df, {"m": F.min(x)})["m"]
    return df.withColumn(name, F.sqrt(x + F.lit(abs(low))) if low is not None and low < 0 else F.sqrt(x))


def rank_transform(df: DataFrame, col: str, name: str) -> DataFrame:
    return average_rank(df, col, name)


def minmax_scale(df: DataFrame, col: str, name: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scale to [low, high]; a constant column becomes ``low``."""
    x = clean_double(df, col)
    s = one_row(df, {"lo": F.min(x), "hi": F.max(x)})
    if s["lo"] is None:
        return df.withColumn(name, x)
    if s["lo"] == s["hi"]:
        return df.withColumn(name, F.when(x.isNotNull(), F.lit(float(low))))
    share = (x - F.lit(s["lo"])) / F.lit(s["hi"] - s["lo"])
    return df.withColumn(name, share * F.lit(float(high - low)) + F.lit(float(low)))


def standardize(df: DataFrame, col: str, name: str, ddof: int = 1) -> DataFrame:
    """(x - mean) / std; a constant column becomes 0."""
    x = clean_double(df, col)
    std = F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)
    s = one_row(df, {"m": F.avg(x), "s": std, "lo": F.min(x), "hi": F.max(x)})
    if not s["s"] or s["lo"] == s["hi"]:
        return df.withColumn(name, F.when(x.isNotNull(), F.lit(0.0)))
    return df.withColumn(name, (x - F.lit(s["m"])) / F.lit(s["s"]))


def levels(df: DataFrame, col: str, cap: int) -> list[object]:
    """Sorted distinct non-null values; more than ``cap`` raises."""
    rows = (df.select(clean(df, col).alias("v")).where("v IS NOT NULL").distinct()
            .limit(cap + 1).collect())
    if len(rows) > cap:
        raise ValueError(f"{col!r} has more than {cap} categories")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, col: str, cap: int = 1000) -> DataFrame:
    """One 0/1 column ``<col>_<value>`` per category; NULL gives all zeros."""
    return df.withColumns({
        f"{col}_{v}": F.coalesce((F.col(f"`{col}`") == F.lit(v)).cast("int"), F.lit(0))
        for v in levels(df, col, cap)})


def label_encode(df: DataFrame, col: str, name: str, literal_cap: int = 1000) -> DataFrame:
    """Codes 0… by sorted category, NULL → -1.

    Few categories become one CASE-free map literal; otherwise the sorted
    category table is indexed in a distributed way and joined back.
    """
    counts = frozen(df.select(clean(df, col).alias("_v")).where("_v IS NOT NULL").groupBy("_v").agg(
        F.count(F.lit(1)).alias("_n")))
    if small(counts, literal_cap):
        values = sorted(r["_v"] for r in counts.collect())
        if not values:
            return df.withColumn(name, F.lit(-1))
        table = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
        return df.withColumn(name, F.coalesce(F.try_element_at(table, clean(df, col)), F.lit(-1)))
    total = counts.agg(F.sum("_n")).first()[0]
    codes = global_index(counts, [F.col("_v")], name)
    keyed = df.withColumn("_v", clean(df, col))
    return (lookup(keyed, codes, "_v", "_n", total).drop("_v")
            .withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(-1))))


def binary_encode(df: DataFrame, col: str, name: str, mapping: dict | None = None) -> DataFrame:
    """0/1 for a two-valued column; without a mapping the smaller value is 0."""
    if mapping is None:
        values = levels(df, col, 2)
        if len(values) != 2:
            raise ValueError(f"{col!r} does not have exactly two values")
        mapping = {values[0]: 0, values[1]: 1}
    return df.withColumn(name, map_values(F.col(f"`{col}`"), mapping))


def map_values(c: Column, mapping: dict) -> Column:
    """Value lookup with NULL for unmapped values."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(None))


def _label(code: Column, labels: Sequence[str] | None, count: int) -> Column:
    if labels is None:
        return code
    if len(labels) != count:
        raise ValueError(f"{count} bins need {count} labels")
    return F.get(F.array(*[F.lit(x) for x in labels]), code)


def equal_width_cuts(low: float, high: float, k: int) -> list[float]:
    if low == high:
        pad = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - pad, high + pad
    return [low + (high - low) * i / k for i in range(1, k)]


def bin_equal_width(df: DataFrame, col: str, k: int, name: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Codes of k equal right-closed intervals."""
    x = clean_double(df, col)
    s = one_row(df, {"lo": F.min(x), "hi": F.max(x)})
    if s["lo"] is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.withColumn(name, _label(bucket_of(x, equal_width_cuts(s["lo"], s["hi"], k)), labels, k))


def bin_equal_freq(df: DataFrame, col: str, k: int, name: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Codes of quantile bins, duplicate edges dropped, right-closed."""
    edges = exact_quantiles(df, {col: [i / k for i in range(k + 1)]})[col]
    edges = sorted({e for e in edges if e is not None})
    inner = edges[1:-1]
    return df.withColumn(name, _label(bucket_of(clean_double(df, col), inner), labels, len(inner) + 1))


def bin_custom(df: DataFrame, col: str, edges: Sequence[float], name: str,
               labels: Sequence[str] | None = None) -> DataFrame:
    """Codes for given edges, right-closed with the lowest edge included; outside → NULL.

    With fewer than two distinct edges, quartiles of the column are used.
    """
    edges = sorted(set(float(e) for e in edges))
    if len(edges) < 2:
        qs = exact_quantiles(df, {col: (0.0, 0.25, 0.5, 0.75, 1.0)})[col]
        edges = sorted({q for q in qs if q is not None})
    if not edges:  # no values at all
        return df.withColumn(name, F.lit(None).cast("string" if labels else "int"))
    x = clean_double(df, col)
    code = F.when((x >= edges[0]) & (x <= edges[-1]), bucket_of(x, edges[1:-1]))
    return df.withColumn(name, _label(code, labels, len(edges) - 1))


def ranked(table: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Zero-based position of the rows of an aggregated table.

    A table proven small is numbered by one window; a large one by the
    distributed index.
    """
    if small(table, 100_000):
        return table.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    return global_index(table, order, name)
