"""Column and table profiles.

Statistics of all columns come from one aggregation (chunked by width), one
output row per column. Distinct counts are exact unless ``exact=False``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.core import (
    FLOATING, clean, clean_double, field_type, is_numeric, local_table, long_stats, melt, numeric_columns,
    one_row, scalar_columns, spread, string_columns)
from timberline.operators.ordering import exact_quantiles

# Words that make a two-valued string column boolean.
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no", "y", "n")

# Signed integer types by their largest magnitude.
INT_WIDTHS = (("tinyint", 2 ** 7), ("smallint", 2 ** 15), ("int", 2 ** 31), ("bigint", 2 ** 63))


def with_distinct(stats: DataFrame, df: DataFrame, cols: Sequence[str], exact: bool = True,
                  name: str = "distinct_values") -> DataFrame:
    """Add the number of distinct values to a per-column table.

    Exact counts group ``(column, value)`` pairs, combined map-side, one pass
    per kind of type; wide multi-distinct aggregates would copy every row once
    per column. ``exact=False`` uses sketches.
    """
    if not exact:
        counts = long_stats(df, {c: {name: F.approx_count_distinct(clean(df, c))} for c in cols})
    else:
        kinds: dict[str, dict[str, Column]] = {}
        for c in cols:
            t = field_type(df, c)
            kind = "bigint" if isinstance(t, T.IntegralType) else "double" if isinstance(t, FLOATING) else "string"
            kinds.setdefault(kind, {})[c] = clean(df, c).cast(kind)
        parts = []
        for values in kinds.values():
            pairs = melt(spread(df), values).where("value IS NOT NULL").groupBy("feature", "value").agg(rows().alias("_k"))
            parts.append(pairs.groupBy("feature").agg(rows().alias(name)))
        counts = reduce(DataFrame.unionByName, parts)
    return stats.join(F.broadcast(counts), "feature", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def rows() -> Column:
    return F.count(F.lit(1))


# --- schema --------------------------------------------------------------

def suggest_schema(df: DataFrame, exact: bool = True) -> DataFrame:
    """Narrowest type per column; strings with few values are categories.

    Whole-number columns get the smallest signed integer that holds their
    range, other numbers ``float``, strings with at most min(100, rows/10)
    distinct values ``category``.
    """
    cols = scalar_columns(df)
    stats = {}
    for c in cols:
        numeric = is_numeric(df, c)
        x = clean_double(df, c) if numeric else F.lit(None).cast("double")
        stats[c] = {
            "current": F.first(F.lit(field_type(df, c).simpleString())),
            "nulls": F.count_if(clean(df, c).isNull()),
            "low": F.min(x), "high": F.max(x),
            "fractions": F.count_if(x != F.floor(x)),
            "n": rows(),
        }
    table = with_distinct(long_stats(df, stats), df, string_columns(df), exact, "levels") if string_columns(df) \
        else long_stats(df, stats).withColumn("levels", F.lit(0))
    width = F.lit("decimal(20,0)")
    for name, size in reversed(INT_WIDTHS):
        width = F.when((F.col("low") >= -float(size)) & (F.col("high") <= float(size - 1)), name).otherwise(width)
    number = F.when(F.col("low").isNull(), F.col("current")).when(F.col("fractions") > 0, "float").otherwise(width)
    suggested = (F.when(F.col("current") == "string",
                        F.when(F.col("levels") <= F.least(F.lit(100.0), F.col("n") / 10.0), "category")
                        .otherwise("string"))
                 .when(F.col("low").isNotNull(), number).otherwise(F.col("current")))
    return table.select("feature", "current", suggested.alias("suggested"), "nulls")


def infer_string_types(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """numeric, boolean, category or text for each string column."""
    cols = string_columns(df, cols)
    stats = {}
    for c in cols:
        s = F.col(f"`{c}`")
        stats[c] = {
            "n": rows(), "filled": F.count(s),
            "not_numeric": F.count_if(s.isNotNull() & s.try_cast("double").isNull()),
            "not_boolean": F.count_if(~F.lower(s).isin(*BOOLEAN_WORDS)),
        }
    kind = (F.when((F.col("filled") > 0) & (F.col("not_numeric") == 0), "numeric")
            .when((F.col("filled") > 0) & (F.col("levels") <= 2) & (F.col("not_boolean") == 0), "boolean")
            .when((F.col("levels") < 50) | (F.col("levels") < F.col("n") * 0.05), "category")
            .otherwise("text"))
    return with_distinct(long_stats(df, stats), df, cols, exact, "levels").select(
        "feature", "levels", kind.alias("inferred"))


def suggest_roles(df: DataFrame, exact: bool = True) -> DataFrame:
    """integer, float, boolean, date, category or text per column.

    A string column is a date when every value parses, a category when under
    half of its values are distinct.
    """
    stats = {}
    for c in scalar_columns(df):
        t = field_type(df, c)
        text = isinstance(t, T.StringType)
        s = F.col(f"`{c}`")
        fixed = ("boolean" if isinstance(t, T.BooleanType) else "integer" if isinstance(t, T.IntegralType)
                 else "float" if isinstance(t, T.NumericType)
                 else "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None)
        stats[c] = {
            "fixed": F.first(F.lit(fixed).cast("string")), "filled": F.count(s),
            "unparsed": F.count_if(s.isNotNull() & F.try_to_timestamp(s).isNull()) if text
            else F.lit(0).cast("long"),
        }
    text_cols = string_columns(df)
    facts = long_stats(df, stats)
    facts = with_distinct(facts, df, text_cols, exact, "levels") if text_cols else facts.withColumn("levels", F.lit(0))
    role = F.coalesce(F.col("fixed"), F.when((F.col("filled") > 0) & (F.col("unparsed") == 0), "date")
                      .when(F.col("levels") < F.col("filled") * 0.5, "category").otherwise("text"))
    return facts.select("feature", role.alias("role"))


# --- columns and table ---------------------------------------------------

def variable_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, missing count and percent, distinct values and an example (the smallest)."""
    cols = scalar_columns(df)
    facts = long_stats(df, {c: {
        "type": F.first(F.lit(field_type(df, c).simpleString())),
        "missing": F.count_if(clean(df, c).isNull()),
        "missing_pct": percent(F.count_if(clean(df, c).isNull()), rows()),
        "example": F.min(clean(df, c)).cast("string"),
    } for c in cols})
    return with_distinct(facts, df, cols, exact)


def analyze_columns(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct values, nulls, smallest and largest value."""
    cols = list(cols or scalar_columns(df))
    facts = long_stats(df, {c: {
        "nulls": F.count_if(clean(df, c).isNull()),
        "min_value": F.min(clean(df, c)).cast("string"),
        "max_value": F.max(clean(df, c)).cast("string"),
    } for c in cols})
    return with_distinct(facts, df, cols, exact)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows and missing cells, with percentages."""
    cols = scalar_columns(df)
    flat = df.select(*[clean(df, c).alias(c) for c in cols])
    missing = F.lit(0).cast("long")
    for c in cols:
        missing = missing + F.col(f"`{c}`").isNull().cast("long")
    copies = flat.groupBy(*[f"`{c}`" for c in cols]).agg(rows().alias("_k"))
    totals = copies.agg(F.sum("_k").alias("rows"), F.sum(F.col("_k") - 1).alias("duplicate_rows"),
                        F.sum(missing * F.col("_k")).alias("missing_cells"))
    width = F.lit(len(cols)).cast("long")
    return totals.select(
        "rows", width.alias("columns"), "duplicate_rows",
        percent(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct"), "missing_cells",
        percent(F.col("missing_cells"), F.col("rows") * width).alias("missing_pct"))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max of the numeric columns."""
    cols = numeric_columns(df, cols)
    q = exact_quantiles(df, {c: (0.25, 0.5, 0.75) for c in cols})
    return long_stats(df, {c: {
        "n": F.count(clean_double(df, c)), "mean": F.avg(clean_double(df, c)),
        "std": F.stddev_samp(clean_double(df, c)), "min": F.min(clean_double(df, c)),
        "q25": F.max(F.lit(q[c][0])), "q50": F.max(F.lit(q[c][1])), "q75": F.max(F.lit(q[c][2])),
        "max": F.max(clean_double(df, c)),
    } for c in cols}, cast={k: "double" for k in ("q25", "q50", "q75")})


def quality_scores(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Completeness, uniqueness and, for numbers, the share not beyond 3 IQR."""
    cols = list(cols or scalar_columns(df))
    numeric = numeric_columns(df, cols)
    q = exact_quantiles(df, {c: (0.25, 0.75) for c in numeric})
    stats = {}
    for c in cols:
        in_range = F.lit(None).cast("double")
        if c in numeric and q[c][0] is not None:
            x, (q1, q3) = clean_double(df, c), q[c]
            far = F.count_if((x < q1 - 3 * (q3 - q1)) | (x > q3 + 3 * (q3 - q1)))
            in_range = F.lit(1.0) - F.try_divide(far, F.count(x)) if q3 > q1 else F.max(F.lit(1.0))
        stats[c] = {
            "completeness": F.try_divide(F.count(clean(df, c)), rows()),
            "in_range": in_range, "_n": rows(),
        }
    return with_distinct(long_stats(df, stats), df, cols, exact, "_d").select(
        "feature", "completeness", F.try_divide("_d", "_n").alias("uniqueness"), "in_range")


# --- distributions -------------------------------------------------------

def skew_class(skew: Column, variant: str = "strict") -> Column:
    """normal, moderately_skewed or highly_skewed by |skew| (population skewness).

    ``strict`` cuts at 0.5 and 1 (the lower class is below the cut), ``loose``
    at 1 and 2 (the higher class is above it).
    """
    a = F.abs(skew)
    if variant == "strict":
        return F.when(a < 0.5, "normal").when(a < 1.0, "moderately_skewed").otherwise("highly_skewed")
    return F.when(a > 2.0, "highly_skewed").when(a > 1.0, "moderately_skewed").otherwise("normal")


def suggested_bins(n: Column, distinct: Column, iqr: Column, spread: Column, std: Column, skew: Column,
                   variant: str = "rules") -> Column:
    """Number of bins from Sturges, square root, Freedman–Diaconis and Scott.

    ``rules`` picks one by skew and size and clamps to 2…20; ``median`` is the
    median of Sturges, square root and Rice clamped to 3…20.
    """
    size = F.greatest(n, F.lit(1)).cast("double")
    sturges = F.ceil(F.log2(size) + 1)
    root = F.ceil(F.sqrt(size))
    if variant == "median":
        rice = F.ceil(F.lit(2.0) * F.pow(size, F.lit(1.0 / 3.0)))
        middle = sturges + root + rice - F.greatest(sturges, root, rice) - F.least(sturges, root, rice)
        return F.greatest(F.lit(3), F.least(F.lit(20), middle)).cast("int")
    cube = F.pow(size, F.lit(1.0 / 3.0))
    fd = F.when((iqr > 0) & (spread > 0), F.ceil(F.try_divide(spread * cube, iqr * 2.0))).otherwise(root)
    scott = F.when((std > 0) & (spread > 0), F.ceil(F.try_divide(spread * cube, std * 3.5))).otherwise(root)
    pick = (F.when(F.abs(skew) > 2.0, F.greatest(sturges, fd))
            .when(distinct < 10, F.least(distinct, F.lit(5)))
            .when(size < 100, F.least(sturges, F.lit(5)))
            .when(size > 1000, F.least(scott, F.lit(15)))
            .otherwise(F.least(root, F.lit(10))))
    clamped = F.greatest(F.lit(2), F.least(F.lit(20), pick, distinct))
    return F.when((n < 2) | (distinct <= 2), F.lit(2)).otherwise(clamped).cast("int")


def feature_profile(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Numeric features: size, missing, range, moments, skew class, outliers, suggested bins."""
    cols = numeric_columns(df, cols)
    q = exact_quantiles(df, {c: (0.25, 0.75) for c in cols})
    stats = {}
    for c in cols:
        x = clean_double(df, c)
        q1, q3 = q[c] if q[c][0] is not None else (0.0, 0.0)
        iqr = q3 - q1
        stats[c] = {
            "n": F.count(x), "missing_pct": percent(F.count_if(x.isNull()), rows()),
            "min": F.min(x), "max": F.max(x), "mean": F.avg(x),
            "std": F.stddev_samp(x), "skew": F.skewness(x), "has_decimals": F.count_if(x != F.floor(x)) > 0,
            "iqr": F.max(F.lit(iqr)),
            "outliers": F.count_if((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)),
        }
    t = with_distinct(long_stats(df, stats), df, cols, exact)
    width = F.col("max") - F.col("min")
    return t.select(
        "feature", "n", "missing_pct", "distinct_values", "min", "max", "mean", "std", "has_decimals",
        (F.col("distinct_values") == 2).alias("is_binary"), "skew",
        skew_class(F.col("skew")).alias("skew_class"), (F.col("outliers") > 0).alias("has_outliers"),
        suggested_bins(F.col("n"), F.col("distinct_values"), F.col("iqr"), width, F.col("std"),
                       F.col("skew")).alias("suggested_bins"))


def outlier_summary(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Values outside q1 - k·iqr … q3 + k·iqr: bounds, count, percent."""
    cols = numeric_columns(df, cols)
    stats = {}
    for c, (q1, q3) in exact_quantiles(df, {c: (0.25, 0.75) for c in cols}).items():
        x = clean_double(df, c)
        low, high = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        out = F.count_if((x < F.lit(low).cast("double")) | (x > F.lit(high).cast("double")))
        stats[c] = {"low": F.max(F.lit(low).cast("double")), "high": F.max(F.lit(high).cast("double")),
                    "outliers": out, "outlier_pct": percent(out, F.count(x))}
    return long_stats(df, stats)


def suggest_bin_count(df: DataFrame, cols: Sequence[str] | None = None, variant: str = "rules",
                      exact: bool = True) -> DataFrame:
    cols = numeric_columns(df, cols)
    q = exact_quantiles(df, {c: (0.25, 0.75) for c in cols})
    t = long_stats(df, {c: {
        "n": F.count(clean_double(df, c)),
        "iqr": F.max(F.lit((q[c][1] - q[c][0]) if q[c][0] is not None else 0.0)),
        "spread": F.max(clean_double(df, c)) - F.min(clean_double(df, c)),
        "std": F.stddev_samp(clean_double(df, c)), "skew": F.skewness(clean_double(df, c)),
    } for c in cols})
    t = with_distinct(t, df, cols, exact, "d")
    return t.select("feature", suggested_bins(*[F.col(k) for k in ("n", "d", "iqr", "spread", "std", "skew")],
                                              variant=variant).alias("suggested_bins"))


def value_counts_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value, n)`` of string-cast columns: one exploded aggregation."""
    long = melt(df, {c: clean(df, c).cast("string") for c in cols})
    return long.where("value IS NOT NULL").groupBy("feature", "value").agg(rows().alias("n"))


def frequency_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Concentration of categories per column.

    Categories are first reduced to "how many categories have count n": at most
    sqrt(2 · rows) entries per column, so the ordered top-3 sum stays small.
    """
    cols = string_columns(df, cols)
    sizes = value_counts_long(df, cols).groupBy("feature", "n").agg(rows().alias("m"))
    down = (Window.partitionBy("feature").orderBy(F.desc("n"))
            .rowsBetween(Window.unboundedPreceding, 0))
    all_rows = Window.partitionBy("feature")
    n, m = F.col("n"), F.col("m")
    placed = (sizes.withColumn("_before", F.sum("m").over(down) - m)
              .withColumn("_total", F.sum(n * m).over(all_rows)))
    top3 = F.greatest(F.lit(0), F.least(m, F.lit(3) - F.col("_before"))) * n
    share = n / F.col("_total")
    t = placed.groupBy("feature").agg(
        F.sum("m").alias("categories"), F.max("_total").alias("n"), F.max("n").alias("_hi"), F.min("n").alias("_lo"),
        F.sum(-share * F.log2(share) * m).alias("entropy"), F.sum(top3).alias("_top3"),
        F.sum(F.when(share > 0.05, m).otherwise(0)).alias("_common"))
    ratio = F.col("_hi") / F.col("_lo")
    return t.select(
        "feature", "categories", percent(F.col("_hi"), F.col("n")).alias("most_frequent_pct"),
        percent(F.col("_lo"), F.col("n")).alias("least_frequent_pct"), ratio.alias("imbalance_ratio"),
        ((F.col("categories") > 1) & (ratio < 5)).alias("is_balanced"), F.abs("entropy").alias("entropy"),
        (F.col("_top3") / F.col("n")).alias("top3_share"), (F.col("_common") / F.col("categories")).alias("uniformity"))


def cardinality_class(distinct: Column) -> Column:
    return (F.when(distinct <= 2, "binary").when(distinct <= 10, "low").when(distinct <= 50, "medium")
            .when(distinct <= 100, "high").otherwise("very_high"))


def category_bins(distinct: Column) -> Column:
    half, fifth = F.floor(distinct / 2.0), F.floor(distinct / 5.0)
    return (F.when(distinct <= 5, distinct).when(distinct <= 20, F.least(F.lit(5), half))
            .otherwise(F.least(F.lit(10), fifth))).cast("int")


def category_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cardinality class, suggested bins, rare categories (< 1 % of the rows), missing."""
    cols = string_columns(df, cols)
    counts = value_counts_long(df, cols)
    total = one_row(df, {"n": rows(), **{c: F.count_if(F.col(f"`{c}`").isNull()) for c in cols}})
    rare = F.count_if(F.col("n") < F.lit(total["n"] * 0.01))
    nulls = F.create_map(*[F.lit(v) for c in cols for v in (c, total[c])])[F.col("feature")]
    t = counts.groupBy("feature").agg(rows().alias("categories"), rare.alias("rare_categories"))
    return t.select("feature", "categories", (F.col("categories") == 2).alias("is_binary"),
                    (F.col("categories") > 50).alias("is_high_cardinality"),
                    cardinality_class(F.col("categories")).alias("cardinality"),
                    category_bins(F.col("categories")).alias("suggested_bins"), "rare_categories",
                    (nulls * F.lit(100.0) / F.lit(total["n"])).alias("missing_pct"))


def top_categories(df: DataFrame, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The n most frequent values per column (limited per partition before the shuffle)."""
    cols = string_columns(df, cols)
    order = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc("value"))
    return (value_counts_long(df, cols).withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= n))


def subset_profile(df: DataFrame, where: Column | str, cols: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Numeric and categorical profiles of the rows that satisfy a predicate."""
    part = df.where(where)
    numeric, text = numeric_columns(part, cols), string_columns(part, cols)
    out = {}
    if numeric:
        out["numeric"] = (describe_numeric(part, numeric)
                          .join(outlier_summary(part, numeric), "feature")
                          .join(long_stats(part, {c: {"skew": F.skewness(clean_double(part, c)),
                                                      "missing": F.count_if(clean(part, c).isNull())}
                                                  for c in numeric}), "feature"))
    if text:
        out["categorical"] = frequency_profile(part, text)
        out["top"] = top_categories(part, text, 5)
    return out


# --- relations to the target --------------------------------------------

def _varying(df: DataFrame, cols: Sequence[str]) -> list[str]:
    s = one_row(df, {f"{k}:{c}": f(clean_double(df, c)) for c in cols for k, f in (("lo", F.min), ("hi", F.max))})
    return [c for c in cols if s[f"lo:{c}"] is not None and s[f"lo:{c}"] != s[f"hi:{c}"]]


def correlations(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of every pair of numeric columns (constant columns left out; below two columns an empty table)."""
    cols = numeric_columns(df, cols)
    df = spread(df.select(*cols))
    cols = _varying(df, cols)
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, is_high boolean")
    stats = {f"{i}": {"a": F.first(F.lit(a)), "b": F.first(F.lit(b)),
                      "r": F.corr(clean_double(df, a), clean_double(df, b))} for i, (a, b) in enumerate(pairs)}
    return long_stats(df, stats, name="_pair").select("a", "b", "r", (F.abs("r") > 0.7).alias("is_high"))


def correlation_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return correlations(df, cols).agg(
        F.max(F.abs("r")).alias("max_abs_r"), F.avg(F.abs("r")).alias("mean_abs_r"),
        F.count_if(F.col("is_high")).alias("high_pairs"))


def target_correlations(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """|r| of every numeric column with the target, ranked."""
    cols = _varying(df, [c for c in numeric_columns(df, cols) if c != target])
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, abs_r double, place int")
    t = long_stats(df, {c: {"abs_r": F.abs(F.corr(clean_double(df, c), clean_double(df, target)))} for c in cols})
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("abs_r"), "feature")))


def variance_relevance(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean of variance / max variance and 1 - mean within-class variance / total variance."""
    cols = [c for c in numeric_columns(df, cols) if c != target]
    whole = long_stats(df, {c: {"variance": F.var_samp(clean_double(df, c))} for c in cols})
    wide = df.where(F.col(f"`{target}`").isNotNull()).groupBy(target).agg(
        *[F.var_samp(clean_double(df, c)).alias(f"v{i}") for i, c in enumerate(cols)])
    within = melt(wide, {c: F.col(f"v{i}") for i, c in enumerate(cols)}, value="v").groupBy("feature").agg(
        F.avg("v").alias("within"))
    t = whole.join(F.broadcast(within), "feature")
    top = F.max("variance").over(Window.partitionBy())
    explained = F.when(F.col("variance") > 0, F.round(1.0 - F.col("within") / F.col("variance"), 4)).otherwise(0.0)
    return t.select("feature", "variance", explained.alias("explained"),
                    ((F.try_divide("variance", top) + explained) / 2.0).alias("relevance"))


def screen_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """|r| with the target (variance without one) scaled by the maximum; other types score 0."""
    cols = [c for c in scalar_columns(df) if c != target]
    stats = {}
    for c in cols:
        raw = F.lit(0.0)
        if is_numeric(df, c):
            x = clean_double(df, c)
            value = F.var_samp(x) if target is None else F.abs(F.corr(x, clean_double(df, target)))
            raw = F.coalesce(F.when(F.isnan(value), 0.0).otherwise(value), F.lit(0.0))
        stats[c] = {"raw": raw}
    t = long_stats(df, stats)
    top = F.max("raw").over(Window.partitionBy())
    return t.select("feature", F.when(top > 0, F.col("raw") / top).otherwise(0.0).alias("score"))


def select_features(scores: DataFrame, method: str, threshold: float) -> DataFrame:
    """Pick rows of a ``(feature, score)`` table.

    min_score, top_n, top_pct or cumulative (smallest prefix reaching the share).
    """
    order = Window.orderBy(F.desc("score"), F.asc("feature"))
    t = scores.withColumn("place", F.row_number().over(order))
    if method == "min_score":
        return t.where(F.col("score") >= threshold)
    if method == "top_n":
        return t.where(F.col("place") <= int(threshold))
    if method == "top_pct":
        total = F.count(F.lit(1)).over(Window.partitionBy())
        return (t.withColumn("_t", total)
                .where(F.col("place") <= F.floor(F.col("_t") * threshold / 100.0)).drop("_t"))
    if method == "cumulative":
        before = F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("score")
        total = F.sum("score").over(Window.partitionBy())
        return (t.withColumn("_before", before / total)
                .where((F.col("_before") < threshold) | (F.col("place") == 1)).drop("_before"))
    raise ValueError(f"unknown selection method {method!r}")


def exclude_features(df: DataFrame, target: str, types: Sequence[str] = ("numeric", "categorical", "datetime"),
                     min_corr: float | None = None, min_variance: float | None = None,
                     max_missing: float | None = None) -> DataFrame:
    """Per feature the facts and whether it is kept under the given limits."""
    stats = {}
    for c in [c for c in scalar_columns(df) if c != target]:
        t = field_type(df, c)
        numeric = is_numeric(df, c)
        kind = ("numeric" if numeric else
                "datetime" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "categorical")
        none = F.lit(None).cast("double")
        stats[c] = {
            "kind": F.first(F.lit(kind)),
            "abs_r": F.abs(F.corr(clean_double(df, c), clean_double(df, target))) if numeric else none,
            "variance": F.var_samp(clean_double(df, c)) if numeric else none,
            "missing_share": F.try_divide(F.count_if(clean(df, c).isNull()), rows()),
        }
    keep = F.col("kind").isin(list(types))
    if min_corr is not None:
        keep = keep & F.coalesce(F.col("abs_r") >= min_corr, F.lit(True))
    if min_variance is not None:
        keep = keep & F.coalesce(F.col("variance") >= min_variance, F.lit(True))
    if max_missing is not None:
        keep = keep & (F.col("missing_share") <= max_missing)
    return long_stats(df, stats).withColumn("keep", keep)


# --- targets -------------------------------------------------------------

def binary_columns(df: DataFrame, max_missing: float = 0.2) -> DataFrame:
    """Columns with at most 20 % nulls and exactly two distinct values.

    A cheap estimate first rules out columns with many values.
    """
    cols = scalar_columns(df)
    rough = one_row(df, {c: F.approx_count_distinct(clean(df, c)) for c in cols})
    cols = [c for c in cols if 1 <= rough[c] <= 10]
    if not cols:
        return local_table(df.sparkSession, [], pa.schema([("feature", pa.string()), ("null_pct", pa.float64())]))
    t = long_stats(df, {c: {"levels": F.count_distinct(clean(df, c)),
                            "null_pct": percent(F.count_if(clean(df, c).isNull()), rows())} for c in cols})
    return t.where((F.col("levels") == 2) & (F.col("null_pct") <= max_missing * 100.0)).select("feature", "null_pct")


def potential_targets(df: DataFrame, max_levels: int = 10) -> DataFrame:
    """Columns with at most ten distinct values: estimated first, then counted."""
    cols = scalar_columns(df)
    rough = one_row(df, {c: F.approx_count_distinct(clean(df, c)) for c in cols})
    cols = [c for c in cols if rough[c] <= max_levels * 2]
    if not cols:
        return local_table(df.sparkSession, [], pa.schema([("feature", pa.string()), ("levels", pa.int64())]))
    return long_stats(df, {c: {"levels": F.count_distinct(clean(df, c))} for c in cols}).where(
        F.col("levels") <= max_levels)


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Class counts of a target with percent, majority flag, gini and entropy."""
    counts = df.groupBy(F.col(f"`{target}`").cast("string").alias("class")).agg(rows().alias("n")).where(
        "class IS NOT NULL")
    whole = Window.partitionBy()
    share = F.col("n") / F.sum("n").over(whole)
    t = counts.withColumn("share", share)
    first = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("class"))) == 1
    return t.select("class", "n", (F.col("share") * 100.0).alias("pct"), first.alias("is_majority"),
                    (1.0 - F.sum(F.col("share") * F.col("share")).over(whole)).alias("gini"),
                    F.sum(-F.col("share") * F.log2("share")).over(whole).alias("entropy"))


def numeric_target_profile(df: DataFrame, target: str) -> DataFrame:
    x = clean_double(df, target)
    median = exact_quantiles(df, {target: (0.5,)})[target][0]
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.max(F.lit(median)).alias("median"),
                  F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"),
                  (F.max(x) - F.min(x)).alias("range"))


def validate_target(df: DataFrame, col: str) -> DataFrame:
    """Is the column fit for binary classification? Imbalance under 0.1 severe, under 0.3 moderate."""
    c = clean(df, col)
    counts = df.groupBy(c.alias("v")).agg(rows().alias("n"))
    t = counts.agg(F.count("v").alias("levels"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
                   F.try_divide(F.min(F.when(F.col("v").isNotNull(), F.col("n"))),
                                F.max(F.when(F.col("v").isNotNull(), F.col("n")))).alias("_ratio"))
    levels = F.col("levels")
    confidence = (F.when(levels == 2, 1.0).when((levels > 2) & (levels <= 10), F.greatest(F.lit(0.0), 1.0 - (levels - 2) * 0.2))
                  .otherwise(0.0))
    imbalance = F.when(levels == 2, F.col("_ratio"))
    return t.select(
        "levels", F.coalesce("nulls", F.lit(0)).cast("long").alias("nulls"), (levels == 2).alias("is_valid"),
        imbalance.alias("imbalance"),
        F.when(imbalance < 0.1, "severe").when(imbalance < 0.3, "moderate").when(levels == 2, "ok").alias("balance"),
        confidence.alias("confidence"))


# Round thresholds tried for a numeric target.
ROUND_THRESHOLDS = (10.0, 50.0, 100.0, 500.0, 1000.0)


def suggest_target_thresholds(df: DataFrame, col: str) -> DataFrame:
    """Median, mean, third quartile and up to three round numbers, with the balance of each cut; empty without values."""
    x = clean_double(df, col)
    median, q3 = exact_quantiles(df, {col: (0.5, 0.75)})[col]
    s = one_row(df, {"mean": F.avg(x), "lo": F.min(x), "hi": F.max(x)})
    if s["hi"] is None:
        return df.sparkSession.createDataFrame([], "kind string, threshold double, below bigint, above bigint, balance double")
    cuts = [("median", median), ("mean", s["mean"]), ("q3", q3)]
    if s["hi"] - s["lo"] > 10:
        cuts += [("round", t) for t in ROUND_THRESHOLDS if s["lo"] < t < s["hi"]]
    t = long_stats(df, {str(i): {"kind": F.first(F.lit(k)), "threshold": F.max(F.lit(v)),
                                 "below": F.count_if(x <= v), "above": F.count_if(x > v)}
                        for i, (k, v) in enumerate(cuts)}, name="_i")
    t = t.drop("_i").withColumn("balance", F.least("below", "above") / F.greatest("below", "above"))
    order = Window.partitionBy("kind").orderBy(F.abs(F.col("balance") - 0.5), "threshold")
    return (t.withColumn("_p", F.row_number().over(order))
            .where((F.col("kind") != "round") | (F.col("_p") <= 3)).drop("_p"))


def binarize_target(df: DataFrame, col: str, mapping: dict, name: str = "target") -> DataFrame:
    """0/1 target from a value mapping; unmapped values become NULL."""
    from timberline.operators.transforms import map_values
    return df.withColumn(name, map_values(F.col(f"`{col}`"), mapping))
