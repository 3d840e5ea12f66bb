"""Split search: class histograms, prefix sums, gains.

All open nodes of a level are searched together. The table is reshaped to
``(group, feature, value)`` and counted per class, combined map-side.

Features with few values are prefix-summed in value order directly. Features
with many values were cut into buckets once per fit, and are searched in two
steps: class counts per bucket give the exact gain at every bucket border and
an upper bound of the gain inside every bucket; only buckets whose bound
reaches the best border are then counted value by value. The result is exact,
and neither a shuffle nor a window group grows with the number of values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.core import BROADCAST_ROWS
from timberline.functions.impurity import GAIN_DIGITS, gain_sql
from timberline.operators.ordering import bucket_of, small

GROUP, FEATURE = "_g", "_f"
CLASS, WEIGHT = "_c", "_w"
EXHAUSTIVE_CATEGORIES = 10

MAX_BOUND_CLASSES = 6   # the bound tries every subset of the classes
SLACK = 1e-11           # gains closer than this are ties and must stay in

# grids are keyed by the feature's position in the feature list
Grid = dict[int, list[float]]


def class_sums(k: int) -> list[Column]:
    return [F.expr(f"sum(CASE WHEN {CLASS} = {i} THEN {WEIGHT} ELSE 0 END) AS c{i}") for i in range(k)]


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def bucket_column(i: int) -> str:
    """Name of the prepared column with the value bucket of feature ``i``."""
    return f"_b{i}"


def _melted(data: DataFrame, features: Sequence[tuple[int, Column]], allowed: Sequence[Sequence[int]] | None,
            bucketed: bool = False) -> DataFrame:
    """Rows to ``(group, class, weight, feature position, value[, bucket])``."""
    items = []
    for i, c in features:
        parts = [F.lit(i).alias(FEATURE), c.alias("v")]
        if bucketed:
            # NULL has a bucket of its own before all values
            own = F.col(bucket_column(i)) if bucket_column(i) in data.columns else F.when(c.isNotNull(), 0)
            parts.append(F.coalesce(own, F.lit(-1)).alias("b"))
        items.append(F.struct(*parts))
    long = data.select(GROUP, CLASS, WEIGHT, F.inline(F.array(*items)))
    if allowed is not None:
        masks = F.array(*[F.array(*[F.lit(i) for i in m]) for m in allowed])
        long = long.where(F.array_contains(F.get(masks, F.col(GROUP)), F.col(FEATURE)))
    return long


def _valid(k: int, min_leaf: float) -> str:
    left, right = " + ".join(names("l", k)), " + ".join(names("r", k))
    return f"({left} >= {min_leaf} AND {right} >= {min_leaf} AND {left} > 0 AND {right} > 0)"


def _with_gain(split: DataFrame, k: int, criterion: str, min_leaf: float) -> DataFrame:
    return (split.where(_valid(k, min_leaf))
            .selectExpr("*", f"{gain_sql(names('l', k), names('r', k), criterion)} AS gain"))


def numeric_candidates(data: DataFrame, features: Sequence[tuple[int, Column]], k: int, totals: DataFrame,
                       criterion: str, min_leaf: float, grid: Grid | None = None,
                       allowed: Sequence[Sequence[int]] | None = None, nulls: bool = True) -> DataFrame:
    """Every threshold with its gain and the class counts left, right and missing.

    ``data`` has group, class index, weight; ``totals`` one row per group with
    ``t0…`` (held by the driver before, hence broadcast). A threshold is the
    midpoint of two neighbouring values, or a point of ``grid`` when given.
    ``nulls=False`` states that no feature has NULLs, which saves their sums.
    """
    grid = grid or {}
    prepared = [(i, bucket_of(c, grid[i]).cast("double") if i in grid else c) for i, c in features]
    hist = _melted(data, prepared, allowed).groupBy(GROUP, FEATURE, "v").agg(*class_sums(k))
    over = f"OVER (PARTITION BY {GROUP}, {FEATURE} ORDER BY v ASC NULLS FIRST"
    rows = f"{over} ROWS UNBOUNDED PRECEDING)"
    missing = "sum(CASE WHEN v IS NULL THEN c{i} ELSE 0 END) " + rows if nulls else "0"
    scanned = hist.selectExpr(
        GROUP, FEATURE, "v", f"lead(v) {over}) AS next", *[f"sum(c{i}) {rows} AS p{i}" for i in range(k)],
        *[f"{missing.format(i=i)} AS m{i}" for i in range(k)]).where("v IS NOT NULL AND next IS NOT NULL")
    threshold = F.expr("(v + next) / 2D")
    for i, points in grid.items():
        table = F.array(*[F.lit(float(p)) for p in points])
        threshold = F.when(F.col(FEATURE) == i, F.get(table, F.col("v").cast("int"))).otherwise(threshold)
    split = scanned.withColumn("threshold", threshold).where("threshold IS NOT NULL").join(
        F.broadcast(totals), GROUP).selectExpr(
        GROUP, FEATURE, "threshold", *[f"CAST(p{i} - m{i} AS DOUBLE) AS l{i}" for i in range(k)],
        *[f"CAST(t{i} - p{i} AS DOUBLE) AS r{i}" for i in range(k)],
        *[f"CAST(m{i} AS DOUBLE) AS m{i}" for i in range(k)])
    return _with_gain(split, k, criterion, min_leaf)


def bucket_table(long: DataFrame, k: int, totals: DataFrame, criterion: str, min_leaf: float,
                 by: Sequence[str]) -> DataFrame:
    """One row per group, feature and value bucket, with what decides about it.

    ``l…, r…, m…``: class counts left of the bucket, from it on, and missing;
    ``gain`` of splitting at its left border; ``bound``, which no split inside
    can exceed; ``best``, the best border gain of the ``by`` group.

    The gain is convex in the left class counts, so inside a bucket it is
    largest when some classes lie completely left and the others right.
    """
    over = f"OVER (PARTITION BY {GROUP}, {FEATURE} ORDER BY b"
    before = f"{over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = long.groupBy(GROUP, FEATURE, "b").agg(*class_sums(k), F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = sums.selectExpr(
        GROUP, FEATURE, "b", "lo", "hi", f"lag(hi) {over}) AS prev", *names("c", k),
        *[f"coalesce(sum(c{i}) {before}, 0) AS o{i}" for i in range(k)],
        *[f"coalesce(sum(CASE WHEN b = -1 THEN c{i} END) {before}, 0) AS m{i}" for i in range(k)]
    ).where("b >= 0").join(F.broadcast(totals), GROUP)
    sides = placed.selectExpr(
        GROUP, FEATURE, "b", "lo", "hi", "prev", *[f"CAST(c{i} AS DOUBLE) AS c{i}" for i in range(k)],
        *[f"CAST(o{i} - m{i} AS DOUBLE) AS l{i}" for i in range(k)],
        *[f"CAST(t{i} - o{i} AS DOUBLE) AS r{i}" for i in range(k)],
        *[f"CAST(m{i} AS DOUBLE) AS m{i}" for i in range(k)])
    bound = "1e9D"
    if k <= MAX_BOUND_CLASSES:
        corners = [gain_sql([f"(l{i} + c{i})" if mask >> i & 1 else f"l{i}" for i in range(k)],
                            [f"(r{i} - c{i})" if mask >> i & 1 else f"r{i}" for i in range(k)], criterion)
                   for mask in range(1 << k)]
        bound = f"greatest(0D, {', '.join(corners)})"     # greatest skips the NULL of an empty side
    border = gain_sql(names("l", k), names("r", k), criterion)
    return sides.selectExpr(
        GROUP, FEATURE, "b", "lo", "prev", *names("l", k), *names("r", k), *names("m", k),
        f"CASE WHEN prev IS NOT NULL AND {_valid(k, min_leaf)} THEN {border} END AS gain",
        f"CASE WHEN lo < hi THEN {bound} END AS bound", "hi").selectExpr(
        "*", f"max(gain) OVER (PARTITION BY {', '.join(by)}) AS best")


def best_numeric_bucketed(data: DataFrame, features: Sequence[tuple[int, Column]], k: int, totals: DataFrame,
                          criterion: str, min_leaf: float, allowed: Sequence[Sequence[int]] | None = None,
                          by: Sequence[str] = (GROUP,), most_buckets: int = BROADCAST_ROWS + 1
                          ) -> tuple[DataFrame, DataFrame]:
    """Best threshold per group when features carry value buckets (``bucket_column``).

    ``most_buckets`` is the caller's bound on groups x features x buckets; open
    buckets are broadcast when it, or else their count, is small. Returned with
    the persisted bucket table, which the caller releases.
    """
    long = _melted(data, features, allowed, bucketed=True)
    table = bucket_table(long, k, totals, criterion, min_leaf, by).persist()
    keys = [GROUP, FEATURE, "b"]
    counts = [*names("l", k), *names("r", k), *names("m", k)]
    open_buckets = table.where(f"bound >= coalesce(best, 0D) - {SLACK}D").select(*keys, *counts)
    few = most_buckets <= BROADCAST_ROWS or small(open_buckets)
    inside = long.where("b >= 0")
    if few:
        inside = inside.join(F.broadcast(open_buckets.select(*keys)), keys, "left_semi")
    hist = inside.groupBy(*keys, "v").agg(*class_sums(k))
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY v"
    scanned = hist.selectExpr(
        *keys, "v", f"lead(v) {over}) AS next",
        *[f"sum(c{i}) {over} ROWS UNBOUNDED PRECEDING) AS p{i}" for i in range(k)]).where("next IS NOT NULL")
    split = scanned.join(F.broadcast(open_buckets) if few else open_buckets, keys).selectExpr(
        GROUP, FEATURE, "(v + next) / 2D AS threshold", *[f"l{i} + p{i} AS l{i}" for i in range(k)],
        *[f"r{i} - p{i} AS r{i}" for i in range(k)], *names("m", k))
    borders = table.where("gain IS NOT NULL").selectExpr(
        GROUP, FEATURE, "(prev + lo) / 2D AS threshold", *counts, "gain")
    return best_numeric(_with_gain(split, k, criterion, min_leaf).unionByName(borders), k, by), table


def best_numeric(candidates: DataFrame, k: int, by: Sequence[str] = (GROUP,)) -> DataFrame:
    """Best threshold per group: gain, then feature order, then smallest threshold."""
    rest = ["gain", *names("l", k), *names("r", k), *names("m", k)]
    best = f"max(struct(round(gain, {GAIN_DIGITS}) AS _r, -{FEATURE} AS _nf, -threshold AS _nt, {', '.join(rest)})) AS _best"
    return candidates.groupBy(*by).agg(F.expr(best)).selectExpr(
        *[c for c in by if c != FEATURE], f"-_best._nf AS {FEATURE}", "-_best._nt AS threshold",
        *[f"_best.{c} AS {c}" for c in rest])


def category_histogram(data: DataFrame, features: Sequence[tuple[int, Column]], k: int,
                       allowed: Sequence[Sequence[int]] | None = None) -> DataFrame:
    return _melted(data, features, allowed).groupBy(GROUP, FEATURE, "v").agg(*class_sums(k))


def best_categorical(data: DataFrame, features: Sequence[tuple[int, Column]], k: int, positive: int,
                     totals: DataFrame, criterion: str, min_leaf: float, search: str = "ordered",
                     allowed: Sequence[Sequence[int]] | None = None, by: Sequence[str] = (GROUP,)) -> DataFrame:
    """Best division of the categories of each group and feature.

    Categories are ordered by positive share and every prefix is tried (for two
    classes this contains the optimum). ``exhaustive`` also tries every subset
    of up to ten categories, ``one_vs_rest`` every single category. The number
    of categories was checked by the caller.
    """
    counts = [f"c{i}" for i in range(k)]
    hist = category_histogram(data, features, k, allowed)
    nulls = hist.where("v IS NULL").select(GROUP, FEATURE, *[F.col(c).alias(f"m{i}") for i, c in enumerate(counts)])
    known = hist.where("v IS NOT NULL")
    rate = F.expr(f"c{positive} / ({' + '.join(counts)})")
    packed = (known.withColumn("rate", rate).groupBy(GROUP, FEATURE)
              .agg(F.array_sort(F.collect_list(F.struct(
                  "rate", "v", F.array(*[F.col(c).cast("double") for c in counts]).alias("n")))).alias("cats")))
    def members(test) -> Column:
        return F.filter("cats", lambda x, i: test(x, i))

    # prefixes: running sums by window, so the work per feature is linear
    long = known.withColumn("rate", rate)
    ordered = Window.partitionBy(GROUP, FEATURE).orderBy("rate", "v")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    last = F.lead("v").over(ordered).isNull()
    prefixes = long.select(
        GROUP, FEATURE, F.row_number().over(ordered).alias("pick"), last.alias("_last"), "v", "rate",
        F.array(*[F.sum(c).over(running).cast("double") for c in counts]).alias("_l"),
        F.array(*[F.col(c).cast("double") for c in counts]).alias("_own"))
    tried = prefixes.where(~F.col("_last")).select(GROUP, FEATURE, "_l", F.col("pick"), F.lit(0).alias("how"))
    if search == "one_vs_rest":
        tried = tried.unionByName(prefixes.select(
            GROUP, FEATURE, F.col("_own").alias("_l"), F.col("pick"), F.lit(1).alias("how")))
    if search == "exhaustive" and k > 2:
        # the last category stays right, so every division is tried once
        few = packed.where(F.size("cats").between(2, EXHAUSTIVE_CATEGORIES)).select(
            GROUP, FEATURE, "cats", F.explode(F.expr("sequence(1, shiftleft(1, size(cats) - 1) - 1)")).alias("pick"))
        zero = F.array(*[F.lit(0.0) for _ in counts])
        subset = F.aggregate(members(lambda x, i: F.getbit(F.col("pick"), i) == 1), zero,
                             lambda a, x: F.zip_with(a, x["n"], lambda p, q: p + q))
        tried = tried.unionByName(few.select(GROUP, FEATURE, subset.alias("_l"), "pick", F.lit(2).alias("how")))
    wide = tried.join(nulls, [GROUP, FEATURE], "left").join(F.broadcast(totals), GROUP)
    split = wide.selectExpr(
        GROUP, FEATURE, "pick", "how", *[f"_l[{i}] AS l{i}" for i in range(k)],
        *[f"CAST(t{i} - coalesce(m{i}, 0) AS DOUBLE) - _l[{i}] AS r{i}" for i in range(k)],
        *[f"CAST(coalesce(m{i}, 0) AS DOUBLE) AS m{i}" for i in range(k)])
    valid = _with_gain(split, k, criterion, min_leaf)
    key = F.struct(F.round("gain", GAIN_DIGITS), -F.col(FEATURE), -F.col("how"), -F.col("pick"))
    row = F.struct(FEATURE, "pick", "how", "gain", *names("l", k), *names("r", k), *names("m", k))
    best = valid.groupBy(*by).agg(F.max_by(row, key).alias("_best")).select(
        *[c for c in by if c != FEATURE], "_best.*")
    chosen = members(lambda x, i: F.when(F.col("how") == 0, i < F.col("pick"))
                     .when(F.col("how") == 1, i == F.col("pick") - 1)
                     .otherwise(F.getbit(F.col("pick"), i) == 1))
    lefts = F.transform(chosen, lambda x: x["v"])
    return (best.join(packed.select(GROUP, FEATURE, "cats"), [GROUP, FEATURE])
            .withColumn("left", F.array_sort(lefts))
            .withColumn("right", F.array_sort(F.array_except(F.transform("cats", lambda x: x["v"]), "left")))
            .drop("cats", "pick", "how"))
