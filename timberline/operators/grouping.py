"""Grouping the categories of a column by what they say about the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.core import frozen, is_numeric
from timberline.operators.binning import MAX_CLASSES
from timberline.operators.ordering import exact_quantiles
from timberline.operators.transforms import ranked

METHODS = ("entropy", "chi_square", "target_mean", "frequency_quartile", "simple", "frequency", "target_rate")


def group_categories(df: DataFrame, col: str, target: str | None = None, method: str = "entropy",
                     max_groups: int | None = None) -> DataFrame:
    """``(category, n, score, grp)`` — groups are numbered from 1, or named by class/level.

    Rows are first counted per category (and class); ordering and grouping work
    on that table only. Ties in a score are ordered by category.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; have {METHODS}")
    c = F.col(f"`{col}`")
    if method in ("simple", "frequency", "frequency_quartile"):
        cats = df.where(c.isNotNull()).groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))
        cats = frozen(cats.withColumn("score", F.col("n").cast("double")))
        if method == "simple":
            return _equal_groups(cats, [F.col("category")], min(max_groups or 5, max(1, cats.count())))
        if method == "frequency":
            return _chunks(cats, [F.desc("n"), F.asc("category")], max_groups or 5)
        low, high = exact_quantiles(cats, {"n": (0.25, 0.75)})["n"]
        level = F.when(F.col("n") >= high, "high").when(F.col("n") >= low, "medium").otherwise("low")
        return cats.select("category", "n", "score", level.alias("grp"))

    if target is None:
        raise ValueError(f"method {method!r} needs a target")
    y = F.col(f"`{target}`")
    rows = df.where(c.isNotNull() & y.isNotNull())
    if method == "target_rate" or (method == "target_mean" and is_numeric(df, target)):
        cats = frozen(rows.groupBy(c.alias("category")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(y.cast("double")).alias("score")))
        order = [F.col("score"), F.col("category")]
        if method == "target_rate":
            return _chunks(cats, order, max_groups or 5)
        return _equal_groups(cats, order, max_groups or 3)

    per_class = frozen(rows.groupBy(c.alias("category"), y.cast("string").alias("y")).agg(
        F.count(F.lit(1)).alias("k")))
    if method == "target_mean":
        top = per_class.groupBy("category").agg(
            F.sum("k").alias("n"),
            F.min_by("y", F.struct(-F.col("k"), F.col("y"))).alias("_top"), F.max("k").alias("_k"))
        return top.select("category", "n", (F.col("_k") / F.col("n")).alias("score"),
                          F.concat(F.lit("Target_"), "_top").alias("grp"))
    if method == "entropy":
        cats = per_class.groupBy("category").agg(
            F.sum("k").alias("n"),
            # H = log2 n - sum(k log2 k) / n
            (F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k")).alias("score"))
        # rounded, so that equal distributions tie exactly
        cats = cats.withColumn("score", F.abs(F.round("score", 12)))
    else:
        cats = _chi_square(per_class)
    return _equal_groups(frozen(cats), [F.col("score"), F.col("category")], max_groups or 3)


def _chi_square(per_class: DataFrame) -> DataFrame:
    """Chi-square of "is this category" against the class, with Yates' correction for 2 x 2."""
    totals = {r["y"]: r["t"] for r in per_class.groupBy("y").agg(F.sum("k").alias("t"))
              .limit(MAX_CLASSES + 1).collect()}
    if len(totals) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    grand = float(sum(totals.values()))
    classes = sorted(totals)
    # A class missing in a category has no row, so the counts go through a map.
    cats = per_class.groupBy("category").agg(
        F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("y", "k"))).alias("_m"))

    def cell(seen: Column, expected: Column) -> Column:
        away = F.abs(seen - expected)
        if len(classes) == 2:
            away = away - F.least(F.lit(0.5), away)
        return away * away / expected

    score = F.lit(0.0)
    for k in classes:
        seen = F.coalesce(F.try_element_at("_m", F.lit(k)), F.lit(0)).cast("double")
        share = F.lit(totals[k] / grand)
        score = score + cell(seen, F.col("n") * share)
        score = score + cell(F.lit(float(totals[k])) - seen, (F.lit(grand) - F.col("n")) * share)
    score = F.when((F.col("n") < grand) & F.lit(len(classes) > 1), score).otherwise(F.lit(0.0))
    return cats.select("category", "n", F.round(score, 9).alias("score"))


def _equal_groups(cats: DataFrame, order: Sequence[Column], groups: int) -> DataFrame:
    """Groups of size count // groups; the last one takes the remainder (or everything)."""
    size = cats.count() // groups
    at = ranked(cats, order, "_i")
    grp = F.least(F.floor(F.col("_i") / F.lit(size)), F.lit(groups - 1)) if size else F.lit(groups - 1)
    return at.select("category", "n", "score", (grp + 1).cast("string").alias("grp"))


def _chunks(cats: DataFrame, order: Sequence[Column], groups: int) -> DataFrame:
    """Consecutive chunks of count // groups; one surplus chunk joins the one before."""
    total = cats.count()
    at = ranked(cats, order, "_i")
    size = 1 if total <= groups else max(1, total // groups)
    last = -(-total // size) - 1
    chunk = F.floor(F.col("_i") / F.lit(size))
    if last + 1 > groups:
        chunk = F.when(chunk == last, last - 1).otherwise(chunk)
    return at.select("category", "n", "score", (chunk + 1).cast("string").alias("grp"))
