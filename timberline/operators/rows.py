"""Row selection: filters, duplicates, samples, outliers, limits, top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.core import clean_double, numeric_columns, one_row
from timberline.functions.conditions import Condition, combine
from timberline.operators.ordering import draw, exact_quantiles, global_index


def filter_rows(df: DataFrame, conditions: Sequence[Condition | tuple | dict],
                precedence: str = "left") -> DataFrame:
    return df.where(combine(df, conditions, precedence))


def filter_expr(df: DataFrame, sql: str) -> DataFrame:
    """Free-text predicate in Spark SQL."""
    return df.where(sql)


def filter_report(df: DataFrame, conditions: Sequence[Condition | tuple | dict],
                  precedence: str = "left") -> DataFrame:
    """Rows before and after a filter, removed rows and percent, in one pass."""
    kept = F.count_if(combine(df, conditions, precedence))
    counts = df.agg(F.count(F.lit(1)).alias("rows_before"), kept.alias("rows_after"))
    removed = F.col("rows_before") - F.col("rows_after")
    return counts.select("rows_before", "rows_after", removed.alias("rows_removed"),
                         F.try_divide(removed * F.lit(100.0), F.col("rows_before")).alias("removed_pct"))


def drop_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def sample_rows(df: DataFrame, key: Sequence[str], n: int | None = None, pct: float | None = None,
                seed: int = 42) -> DataFrame:
    """Exact-size random sample: the rows with the smallest draws.

    Small sizes are a distributed top-k. Larger ones locate the size-th draw by
    counting draw prefixes first, so no task sorts the whole table.
    """
    if (n is None) == (pct is None):
        raise ValueError("give either n or pct")
    drawn = df.withColumn("_draw", draw(key, seed))
    if n is None:
        n = round(df.count() * pct / 100.0)
    order = [F.col("_draw"), *[F.col(k) for k in key]]
    if n <= 10_000:
        return drawn.orderBy(*order).limit(n).drop("_draw")
    # Three hex digits give 4096 buckets; whole buckets below the cut are taken
    # as they are, only the cut bucket is ordered.
    bucket = F.substring("_draw", 1, 3)
    sizes = {r["b"]: r["count"] for r in drawn.groupBy(bucket.alias("b")).count().collect()}
    left, cut = n, None
    for b in sorted(sizes):
        if sizes[b] > left:
            cut = b
            break
        left -= sizes[b]
    if cut is None:
        return drawn.drop("_draw")
    whole = drawn.where(bucket < cut)
    if left == 0:
        return whole.drop("_draw")
    part = global_index(drawn.where(bucket == cut), order, "_i").where(F.col("_i") < left).drop("_i")
    return whole.unionByName(part).drop("_draw")


def limit_rows(df: DataFrame, order_by: Sequence[str | Column], skip: int = 0, skip_tail: int = 0,
               n: int | None = None) -> DataFrame:
    """Drop the first ``skip`` and last ``skip_tail`` rows of an order, keep ``n``."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if not skip_tail and n is not None and skip + n <= 10_000:
        ordered = df.orderBy(*order)
        return (ordered.offset(skip) if skip else ordered).limit(n)
    indexed = global_index(df, order, "_i")
    last = indexed.count() - skip_tail
    if n is not None:
        last = min(last, skip + n)
    return indexed.where((F.col("_i") >= skip) & (F.col("_i") < last)).drop("_i")


def top_rows(df: DataFrame, col: str, n: int, ascending: bool = False,
             then: Sequence[str] = ()) -> DataFrame:
    """The first n rows by a column (planned as a distributed top-k)."""
    c = F.col(col)
    first = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return df.orderBy(first, *then).limit(n)


def outlier_bounds(df: DataFrame, cols: Sequence[str], method: str = "iqr",
                   threshold: float | None = None) -> dict[str, tuple[float, float, bool]]:
    """Per column ``(low, high, closed)``: values inside are kept."""
    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        out = {}
        for c, (q1, q3) in exact_quantiles(df, {c: (0.25, 0.75) for c in cols}).items():
            if q1 is not None:
                out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1), True)
        return out
    if method == "zscore":
        t = 3.0 if threshold is None else threshold
        stats = one_row(df, {f"{s}:{c}": f(clean_double(df, c)) for c in cols
                             for s, f in (("m", F.avg), ("s", F.stddev_samp))})
        return {c: (stats[f"m:{c}"] - t * stats[f"s:{c}"], stats[f"m:{c}"] + t * stats[f"s:{c}"], False)
                for c in cols if stats[f"s:{c}"]}
    if method == "modified_zscore":
        t = 3.5 if threshold is None else threshold
        medians = {c: q[0] for c, q in exact_quantiles(df, {c: (0.5,) for c in cols}).items()
                   if q[0] is not None}
        if not medians:
            return {}
        away = df.select(*[F.abs(clean_double(df, c) - F.lit(m)).alias(c) for c, m in medians.items()])
        mads = exact_quantiles(away, {c: (0.5,) for c in medians})
        # 0.6745 * |x - median| / MAD < t
        return {c: (m - t * mads[c][0] / 0.6745, m + t * mads[c][0] / 0.6745, False)
                for c, m in medians.items() if mads[c][0]}
    raise ValueError(f"unknown outlier method {method!r}")


def remove_outliers(df: DataFrame, method: str = "iqr", threshold: float | None = None,
                    cols: Sequence[str] | None = None, sequential: bool = False) -> DataFrame:
    """Keep rows inside the bounds of every numeric column; NULL counts as outside.

    The bounds come from the full table; ``sequential=True`` recomputes them
    column after column on the rows that are left.
    """
    cols = numeric_columns(df, cols)

    def keep(frame: DataFrame, part: Sequence[str]) -> DataFrame:
        for c, (low, high, closed) in outlier_bounds(frame, part, method, threshold).items():
            x = F.col(f"`{c}`")    # NaN is above every bound
            inside = (x >= low) & (x <= high) if closed else (x > low) & (x < high)
            frame = frame.where(inside)
        return frame

    if not sequential:
        return keep(df, cols)
    for c in cols:
        df = keep(df, [c])
    return df
