"""Supervised binning: edges, bin statistics, split quality, previews.

Bins are left-closed, the last one closed on both sides. One pass over the
table yields the class counts per bin; that table has at most
``bins x classes`` entries, so the scores derived from it are plain numbers.
"""

from __future__ import annotations

import statistics
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.core import clean_double, local_table, one_row, spread
from timberline.functions.impurity import impurity_of
from timberline.operators.ordering import bucket_of, exact_quantiles, with_replicates

MAX_CLASSES = 1000


# --- edges ---------------------------------------------------------------

def _filled(col: str, values: Sequence[float | None]) -> list[float]:
    if any(v is None for v in values):
        raise ValueError(f"column {col!r} has no values")
    return list(values)


def edges_equal_width(df: DataFrame, col: str, k: int) -> list[float]:
    """k + 1 equally spaced edges; a constant column is widened a little."""
    x = clean_double(df, col)
    s = one_row(df, {"lo": F.min(x), "hi": F.max(x)})
    low, high = _filled(col, [s["lo"], s["hi"]])
    if low == high:
        pad = max(0.001, abs(low) * 0.001)
        low, high = low - pad, high + pad
    return [low + (high - low) * i / k for i in range(k)] + [high]


def edges_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    return sorted(set(_filled(col, exact_quantiles(df, {col: list(probs)})[col])))


def edges_equal_freq(df: DataFrame, col: str, k: int) -> list[float]:
    return edges_quantiles(df, col, [i / k for i in range(k + 1)])


# The quantiles of each preset.
PRESETS = {
    2: [0.0, 0.5, 1.0],
    3: [0.0, 0.33, 0.67, 1.0],
    4: [0.0, 0.25, 0.5, 0.75, 1.0],
    5: [0.0, 0.2, 0.4, 0.6, 0.8, 1.0],
    10: [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
}


def edges_quantile(df: DataFrame, col: str, k: int) -> list[float]:
    return edges_quantiles(df, col, PRESETS.get(k) or [i / k for i in range(k + 1)])


def edges_outlier(df: DataFrame, col: str) -> list[float]:
    """Low outliers, normal range, high outliers; empty outer bins are left out."""
    low, q1, q3, high = _filled(col, exact_quantiles(df, {col: (0.0, 0.25, 0.75, 1.0)})[col])
    lower, upper = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return sorted({low, high, *[e for e in (lower, upper) if low < e < high]})


def validate_bins(df: DataFrame, col: str, bins: Sequence[tuple[float, float]]) -> DataFrame:
    """One row: are the (low, high) bins ordered, gapless, not overlapping, covering?"""
    x = clean_double(df, col)
    s = one_row(df, {"lo": F.min(x), "hi": F.max(x)})
    problems = []
    if any(lo >= hi for lo, hi in bins):
        problems.append("empty_interval")
    ordered = sorted(bins)
    pairs = list(zip(ordered, ordered[1:]))
    if any(a[1] - b[0] > 1e-10 for a, b in pairs):
        problems.append("overlap")
    if any(b[0] - a[1] > 1e-10 for a, b in pairs):
        problems.append("gap")
    if not bins or (s["lo"] is not None and (ordered[0][0] > s["lo"] or max(b[1] for b in bins) < s["hi"])):
        problems.append("range_not_covered")
    return local_table(
        df.sparkSession,
        [{"valid": not problems, "problems": ",".join(problems), "data_min": s["lo"], "data_max": s["hi"]}],
        pa.schema([("valid", pa.bool_()), ("problems", pa.string()),
                   ("data_min", pa.float64()), ("data_max", pa.float64())]))


# --- class counts per bin ------------------------------------------------

def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Bin number, -1 outside the edges, NULL for NULL."""
    inside = bucket_of(x, list(edges)[1:-1], right=False)
    return F.when((x < edges[0]) | (x > edges[-1]), F.lit(-1)).otherwise(inside)


@dataclass(frozen=True)
class BinCounts:
    """Class counts of every bin, with rows outside the bins and NULL rows apart."""
    edges: tuple[float, ...]
    classes: tuple[str, ...]
    counts: tuple[tuple[float, ...], ...]   # per bin, per class
    nulls: tuple[float, ...]
    outside: tuple[float, ...]
    target_sums: tuple[float, ...] = ()     # per bin, then NULL rows last

    @property
    def sizes(self) -> list[float]:
        return [sum(c) for c in self.counts]

    @property
    def total(self) -> float:
        return sum(self.sizes) + sum(self.nulls) + sum(self.outside)

    @property
    def all_classes(self) -> list[float]:
        rows = [*self.counts, self.nulls, self.outside]
        return [sum(r[i] for r in rows) for i in range(len(self.classes))]

    def with_nulls_in_largest(self) -> "BinCounts":
        """NULL rows counted (sizes and classes alike) into the first largest bin."""
        if not sum(self.nulls):
            return self
        big = max(range(len(self.counts)), key=lambda i: (self.sizes[i], -i))
        merged = [list(c) for c in self.counts]
        merged[big] = [a + b for a, b in zip(merged[big], self.nulls)]
        sums = list(self.target_sums)
        if sums:
            sums[big] += sums[-1]
            sums[-1] = 0.0
        zero = tuple(0.0 for _ in self.classes)
        return BinCounts(self.edges, self.classes, tuple(map(tuple, merged)), zero, self.outside, tuple(sums))


def bin_counts(df: DataFrame, col: str, edges: Sequence[float], target: str) -> BinCounts:
    """One pass: rows per bin and class (map-side combined, bins x classes out)."""
    edges = [float(e) for e in edges]
    if len(edges) < 2:
        raise ValueError("at least two edges are needed")
    y = F.col(f"`{target}`")
    limit = MAX_CLASSES * (len(edges) + 2)
    rows = (df.where(y.isNotNull())
            .groupBy(bin_index(clean_double(df, col), edges).alias("b"), y.cast("string").alias("y"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(y.try_cast("double")).alias("s"))
            .limit(limit).collect())
    classes = sorted({r["y"] for r in rows})
    if len(classes) > MAX_CLASSES or len(rows) == limit:
        raise ValueError(f"target {target!r} has more than {MAX_CLASSES} classes")
    at = {(r["b"], r["y"]): float(r["n"]) for r in rows}
    k = len(edges) - 1

    def line(b: int | None) -> tuple[float, ...]:
        return tuple(at.get((b, c), 0.0) for c in classes)

    sums = tuple(sum(r["s"] or 0.0 for r in rows if r["b"] == b) for b in [*range(k), None])
    return BinCounts(tuple(edges), tuple(classes), tuple(line(b) for b in range(k)), line(None), line(-1), sums)


def bin_stats(df: DataFrame, col: str, edges: Sequence[float], target: str) -> DataFrame:
    """Per bin: size, percent, class counts, mean target, gini; empty bins kept."""
    t = bin_counts(df, col, edges, target).with_nulls_in_largest()
    rows = []
    for i, c in enumerate(t.counts):
        n = sum(c)
        rows.append({
            "bin": i, "lower": t.edges[i], "upper": t.edges[i + 1], "n": int(n),
            "pct": 100.0 * n / t.total if t.total else 0.0,
            "class_counts": [(k, int(v)) for k, v in zip(t.classes, c)],
            "mean_target": t.target_sums[i] / n if n else None,
            "gini": impurity_of(c, "gini")})
    return local_table(df.sparkSession, rows, pa.schema([
        ("bin", pa.int32()), ("lower", pa.float64()), ("upper", pa.float64()), ("n", pa.int64()),
        ("pct", pa.float64()), ("class_counts", pa.map_(pa.string(), pa.int64())),
        ("mean_target", pa.float64()), ("gini", pa.float64())]))


def category_stats(df: DataFrame, col: str, target: str) -> DataFrame:
    """The same statistics with one bin per category (lazy; any number of categories)."""
    y = F.col(f"`{target}`")
    per_class = (df.where(y.isNotNull())
                 .groupBy(F.col(f"`{col}`").cast("string").alias("category"), y.cast("string").alias("y"))
                 .agg(F.count(F.lit(1)).alias("c"), F.sum(y.try_cast("double")).alias("s")))
    per_cat = per_class.groupBy("category").agg(
        F.sum("c").alias("n"), F.try_divide(F.sum("s"), F.sum("c")).alias("mean_target"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("y", "c")))).alias("class_counts"),
        F.sum(F.col("c") * F.col("c")).alias("_sq"))
    return per_cat.select("category", "n", "mean_target", "class_counts",
                          (F.lit(1.0) - F.col("_sq") / (F.col("n") * F.col("n"))).alias("gini"))


def merge_small_edges(t: BinCounts, min_n: float) -> list[float]:
    """Edges left after every bin under ``min_n`` joined its right neighbour (the last one its left)."""
    edges, sizes = list(t.edges), t.sizes
    i = 0
    while i < len(sizes) and len(sizes) > 1:
        if sizes[i] >= min_n:
            i += 1
            continue
        j = i if i + 1 < len(sizes) else i - 1
        sizes[j:j + 2] = [sizes[j] + sizes[j + 1]]
        del edges[j + 1]
        i = j
    return edges


def merge_small_bins(df: DataFrame, col: str, edges: Sequence[float], target: str,
                     min_n: int | None = None, min_share: float | None = None) -> list[float]:
    t = bin_counts(df, col, edges, target)
    return merge_small_edges(t, min_n if min_n is not None else t.total * (min_share or 0.05))


# --- split quality -------------------------------------------------------

def quality(t: BinCounts, criterion: str = "gini") -> dict:
    """Impurity before and after, decrease, relative decrease and per-bin facts.

    NULL rows and rows outside the edges are two more groups of the division, so a feature gains nothing by having
    NULLs; they are no bins and do not count as small, empty or largest.
    """
    before = impurity_of(t.all_classes, criterion)
    n = t.total
    after = sum(sum(c) / n * impurity_of(c, criterion) for c in (*t.counts, t.nulls, t.outside)) if n else 0.0
    small_limit = max(1, int(n) // 20)
    bins = []
    for i, c in enumerate(t.counts):
        size = sum(c)
        imp = impurity_of(c, criterion)
        bins.append({"bin": i, "lower": t.edges[i], "upper": t.edges[i + 1], "n": int(size),
                     "pct": 100.0 * size / n if n else 0.0, "impurity": imp,
                     "purity": 1.0 - imp if size else 0.0, "is_small": size < small_limit,
                     "top_class": max(zip(c, t.classes), key=lambda p: (p[0], [-ord(ch) for ch in p[1]]))[1]
                     if size else None})
    decrease = before - after
    filled = [b for b in bins if b["n"]]
    return {"impurity_before": before, "impurity_after": after, "impurity_decrease": decrease,
            "gain_ratio": decrease / before if before > 0 else 0.0, "bins": bins, "n": int(n),
            "n_bins": len(bins), "empty_bins": len(bins) - len(filled), "small_bins": sum(b["is_small"] for b in filled),
            "binned": sum(b["n"] for b in bins), "largest": max((b["n"] for b in filled), default=0),
            "smallest": min((b["n"] for b in filled), default=0),
            "mean_purity": statistics.fmean(b["purity"] for b in filled) if filled else 0.0,
            "least_purity": min((b["purity"] for b in filled), default=0.0)}


# When a binning has an issue, a strength, a warning, and what is advised; conditions on its quality.
ISSUES = {
    "empty_bins": "empty_bins > 0",
    "small_bins": "small_bins > 0",
    "no_improvement": "impurity_decrease <= 0",
    "tiny_improvement": "impurity_decrease > 0 AND impurity_decrease < 0.01",
    "low_gain_ratio": "gain_ratio < 0.1",
    "imbalanced_bins": "largest > 10 * smallest",
}
STRENGTHS = {
    "good_decrease": "impurity_decrease >= 0.01",
    "high_gain_ratio": "gain_ratio > 0.3",
    "balanced_bins": "smallest > 0 AND largest < 3 * smallest",
}
WARNINGS = {
    "empty_bins": "empty_bins > 0",
    "no_improvement": "impurity_decrease <= 0",
    "bins_under_3_rows": "smallest BETWEEN 1 AND 2",
    "very_low_gain": "gain_ratio < 0.05",
    "one_bin_over_80_pct": "largest > 0.8 * binned",
    "all_bins_pure": "empty_bins = 0 AND least_purity > 0.95",
}
ADVICE = {
    "remove_empty_bins": "empty_bins > 0",
    "merge_small_bins": "small_bins > 0",
    "try_other_feature": "gain_ratio < 0.1",
    "use_equal_frequency": "largest > 10 * smallest",
    "ready_to_apply": "label IN ('good', 'excellent')",
    "acceptable": "label = 'fair'",
    "fewer_bins": "n_bins > binned div 10",
    "strong_binary_split": "n_bins = 2 AND gain_ratio > 0.3 AND n_bins <= binned div 10",
}
LABELS = "CASE WHEN score >= 70 THEN 'excellent' WHEN score >= 50 THEN 'good' WHEN score >= 30 THEN 'fair' WHEN score >= 10 THEN 'poor' ELSE 'very_poor' END"

_DOUBLES = ("impurity_before", "impurity_after", "impurity_decrease", "gain_ratio", "mean_purity", "least_purity")
_LONGS = ("n", "n_bins", "empty_bins", "small_bins", "binned", "largest", "smallest")


def quality_table(spark, named: dict[str, dict]) -> DataFrame:
    """One row per binning: ``place``, ``name`` and its quality."""
    return local_table(spark, [{"place": i, "name": name, **q} for i, (name, q) in enumerate(named.items())], pa.schema(
        [("place", pa.int32()), ("name", pa.string()), *[(c, pa.float64()) for c in _DOUBLES], *[(c, pa.int64()) for c in _LONGS]]))


def _holding(rules: dict[str, str]) -> Column:
    """The names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))


def rated(table: DataFrame) -> DataFrame:
    """``issues``, ``strengths``, ``score`` (0 to 100) and ``label`` beside the quality."""
    found = table.withColumns({"issues": _holding(ISSUES), "strengths": _holding(STRENGTHS)})
    points = F.least(F.col("gain_ratio") * 100, F.lit(50.0)) - 10 * F.size("issues") + 5 * F.size("strengths")
    return found.withColumn("score", F.greatest(points, F.lit(0.0))).withColumn("label", F.expr(LABELS))


def _quality_of(df: DataFrame, col: str, edges: Sequence[float], target: str, criterion: str) -> DataFrame:
    return quality_table(df.sparkSession, {col: quality(bin_counts(df, col, edges, target), criterion)})


def bin_split_quality(df: DataFrame, col: str, edges: Sequence[float], target: str,
                      criterion: str = "gini") -> DataFrame:
    """One row with impurity before/after, decrease, gain ratio, small and empty bins."""
    return _quality_of(df, col, edges, target, criterion).select(
        "impurity_before", "impurity_after", "impurity_decrease", "gain_ratio", "n_bins", "empty_bins", "small_bins")


def rate_split(df: DataFrame, col: str, edges: Sequence[float], target: str, criterion: str = "gini") -> DataFrame:
    """Score and label of a binning with its issues and strengths."""
    counted = lambda c: F.size(c).cast("long").alias(c)
    return rated(_quality_of(df, col, edges, target, criterion)).select(
        "score", "label", counted("issues"), counted("strengths"),
        F.array_join("issues", ",").alias("issue_list"), F.array_join("strengths", ",").alias("strength_list"))


def bin_importance(df: DataFrame, col: str, edges: Sequence[float], target: str, total_rows: int | None = None,
                   criterion: str = "gini") -> DataFrame:
    """Impurity decrease times the share of ``total_rows`` seen here."""
    q = quality(bin_counts(df, col, edges, target), criterion)
    share = q["n"] / (total_rows or q["n"]) if q["n"] else 0.0
    return local_table(df.sparkSession, [{"feature": col, "importance": q["impurity_decrease"] * share}],
                       pa.schema([("feature", pa.string()), ("importance", pa.float64())]))


def deviance_reduction(df: DataFrame, col: str, edges: Sequence[float], target: str) -> DataFrame:
    """-2 n (p ln p + (1-p) ln(1-p)) of the whole minus that of the bins, and its share."""
    t = bin_counts(df, col, edges, target)
    before = 2.0 * t.total * impurity_of(t.all_classes, "deviance")
    after = sum(2.0 * sum(c) * impurity_of(c, "deviance") for c in (*t.counts, t.nulls, t.outside))
    return local_table(
        df.sparkSession, [{"deviance_before": before, "deviance_after": after, "reduction": before - after,
                           "reduction_ratio": (before - after) / before if before else 0.0}],
        pa.schema([(k, pa.float64()) for k in
                   ("deviance_before", "deviance_after", "reduction", "reduction_ratio")]))


def coarsen(t: BinCounts, edges: Sequence[float]) -> BinCounts:
    """The counts of a coarser binning whose edges are a subset of ``t.edges``."""
    at = {e: i for i, e in enumerate(t.edges)}
    spans = [(at[lo], at[hi]) for lo, hi in zip(edges, edges[1:])]
    merged = tuple(tuple(sum(t.counts[j][c] for j in range(a, b)) for c in range(len(t.classes)))
                   for a, b in spans)
    outside = list(t.outside)
    for j in [*range(0, spans[0][0]), *range(spans[-1][1], len(t.counts))]:
        outside = [a + b for a, b in zip(outside, t.counts[j])]
    return BinCounts(tuple(edges), t.classes, merged, t.nulls, tuple(outside))


def optimal_bins(df: DataFrame, col: str, target: str, max_bins: int = 10, min_n: int = 5,
                 criterion: str = "gini") -> DataFrame:
    """Best-rated quantile binning with 2…max_bins bins.

    All quantiles come from one call and all candidate binnings are merged from
    one counted pass over the union of their edges.
    """
    probs = sorted({i / k for k in range(2, max_bins + 1) for i in range(k + 1)})
    value = dict(zip(probs, _filled(col, exact_quantiles(df, {col: probs})[col])))
    options = {k: sorted({value[i / k] for i in range(k + 1)}) for k in range(2, max_bins + 1)}
    options = {k: e for k, e in options.items() if len(e) > 1}
    fitting = {}
    if options:
        fine = bin_counts(df, col, sorted({e for edges in options.values() for e in edges}), target)
        for k, edges in options.items():
            t = coarsen(fine, edges)
            if k <= fine.total // min_n and not any(0 < n < min_n for n in t.sizes):
                fitting[k] = quality(t, criterion)
    spark = df.sparkSession
    chosen = local_table(spark, [{"requested_bins": k, "edges": options[k]} for k in fitting] or [{"requested_bins": 2, "edges": edges_quantiles(df, col, (0.0, 0.5, 1.0))}],
                         pa.schema([("requested_bins", pa.int64()), ("edges", pa.list_(pa.float64()))]))
    scores = rated(quality_table(spark, {str(k): q for k, q in fitting.items()})).select(F.col("name").cast("long").alias("requested_bins"), "score")
    return (chosen.join(F.broadcast(scores), "requested_bins", "left")  # one row per number of bins
            .select("requested_bins", (F.size("edges") - 1).cast("long").alias("n_bins"), F.coalesce("score", F.lit(0.0)).alias("score"), "edges")
            .orderBy(F.desc("score"), "requested_bins").limit(1))


def bin_stability(df: DataFrame, key: Sequence[str], col: str, edges: Sequence[float], target: str,
                  n_boot: int = 100, seed: int = 42, criterion: str = "gini") -> DataFrame:
    """Spread of split quality over bootstrap replicates.

    The replicates are extra sums in one aggregation, so rows are neither
    copied nor resampled.
    """
    y = F.col(f"`{target}`")
    binned = spread(df.where(y.isNotNull()).select(
        *key, bin_index(clean_double(df, col), edges).alias("_b"), y.cast("string").alias("_y")))
    rows = (with_replicates(binned, key, n_boot, seed).groupBy(F.col("_b").alias("b"), F.col("_y").alias("y"))
            .agg(*[F.sum(f"w{r}").alias(f"w{r}") for r in range(n_boot)]).limit(MAX_CLASSES * (len(edges) + 1) + 1).collect())
    classes = tuple(sorted({r["y"] for r in rows}))
    if len(classes) > MAX_CLASSES or len(rows) > MAX_CLASSES * (len(edges) + 1):
        raise ValueError(f"target {target!r} has more than {MAX_CLASSES} classes")
    ratios, decreases = [], []
    for r in range(n_boot):
        at = {(x["b"], x["y"]): float(x[f"w{r}"]) for x in rows}
        lines = {b: tuple(at.get((b, c), 0.0) for c in classes) for b in [*range(len(edges) - 1), None, -1]}
        q = quality(BinCounts(tuple(edges), classes, tuple(lines[b] for b in range(len(edges) - 1)),
                              lines[None], lines[-1]), criterion)
        ratios.append(q["gain_ratio"])
        decreases.append(q["impurity_decrease"])
    ratio_std = statistics.pstdev(ratios)
    row = {"mean_gain_ratio": statistics.fmean(ratios), "gain_ratio_std": ratio_std,
           "mean_impurity_decrease": statistics.fmean(decreases),
           "impurity_decrease_std": statistics.pstdev(decreases),
           "stability_score": 1.0 / (1.0 + ratio_std) if statistics.fmean(ratios) > 0 else 0.0}
    return local_table(df.sparkSession, [row], pa.schema([(k, pa.float64()) for k in row]))


# --- previews ------------------------------------------------------------

# Status of a bin, and its score from size and purity.
STATUS = "CASE WHEN n = 0 THEN 'empty' WHEN is_small THEN 'small' WHEN purity > 0.9 THEN 'pure' ELSE 'normal' END"
BY_SIZE = "CASE WHEN n >= 10 THEN 10 WHEN n >= 5 THEN 5 ELSE 0 END - IF(is_small, 20, 0)"
BY_PURITY = "CASE WHEN purity > 0.7 THEN 20 WHEN purity > 0.5 THEN 10 WHEN purity < 0.1 THEN -15 ELSE 0 END"


def preview_split(df: DataFrame, col: str, edges: Sequence[float], target: str,
                  criterion: str = "gini") -> dict[str, DataFrame]:
    """``{"summary": one row, "bins": one row per bin}`` for a proposed binning."""
    q = quality(bin_counts(df, col, edges, target), criterion)
    summary = rated(quality_table(df.sparkSession, {col: q})).select(
        F.col("name").alias("feature"), "n_bins", (F.col("n_bins") - F.col("empty_bins")).alias("n_filled"), F.col("binned").alias("n"),
        "impurity_before", "impurity_after", "impurity_decrease", "gain_ratio", "score", "label",
        (F.col("impurity_decrease") > 0).alias("beneficial"), "mean_purity", F.col("smallest").alias("min_bin"), F.col("largest").alias("max_bin"),
        F.array_join(_holding(WARNINGS), ",").alias("warnings"), F.array_join(_holding(ADVICE), ",").alias("recommendations"))
    f = pa.float64()
    bins = local_table(df.sparkSession, q["bins"], pa.schema([
        ("bin", pa.int32()), ("lower", f), ("upper", f), ("n", pa.int64()), ("pct", f), ("impurity", f), ("purity", f),
        ("is_small", pa.bool_()), ("top_class", pa.string())]))
    points = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + F.expr(BY_SIZE) + F.expr(BY_PURITY)))
    bins = bins.withColumns({"status": F.expr(STATUS), "bin_score": F.when(F.col("n") == 0, 0.0).otherwise(points)}).drop("is_small")
    return {"summary": summary, "bins": bins}


def compare_splits(df: DataFrame, col: str, configs: dict[str, Sequence[float]], target: str,
                   criterion: str = "gini") -> DataFrame:
    """One row per named binning with flags for best score, gain ratio and balance (the first on ties).

    All binnings are merged from one pass over the union of their edges.
    """
    fine = bin_counts(df, col, sorted({float(e) for edges in configs.values() for e in edges}), target)
    named = {name: quality(coarsen(fine, [float(e) for e in edges]), criterion) for name, edges in configs.items()}
    out = rated(quality_table(df.sparkSession, named)).withColumn("balance", F.col("score") - 5.0 * (F.col("n_bins") - 2))

    def first_by(c: str) -> Column:  # one row per binning given
        return F.row_number().over(Window.orderBy(F.desc(c), "place")) == 1

    return out.select("name", "score", "gain_ratio", "impurity_decrease", "n_bins", "empty_bins", "label", "balance",
                      first_by("score").alias("best_score"), first_by("gain_ratio").alias("best_gain"), first_by("balance").alias("best_balance"))
