"""Growing trees level by level, and split search on one node.

Every level is one aggregation job per feature batch for all open nodes
together. The driver sees one row per open node and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.core import clean_double, field_type, is_small, local_table, long_stats, one_row, spread
from timberline.functions.impurity import gain_sql, impurity_of, measure
from timberline.operators.missing import MISSING, impute, modes
from timberline.operators.ordering import bucket_of, draw_text, exact_quantiles, running_sums, value_edges
from timberline.operators.scoring import CASE_LEAVES, assign_leaf
from timberline.operators.splits import (
    CLASS, FEATURE, GROUP, WEIGHT, best_categorical, best_numeric, best_numeric_bucketed, bucket_column,
    numeric_candidates)
from timberline.operators.transforms import levels
from timberline.plans.tree import ROOT, TYPED, Node, Split, TreeModel, positive_class

ROOT_GROUP = "_root"

PURE = 1e-4  # fixed value: impurity at or below which a node is not split


@dataclass(frozen=True)
class TreeParams:
    criterion: str = "entropy"
    max_depth: int = 10
    min_samples_split: float = 2
    min_samples_leaf: float = 1
    min_impurity_decrease: float = 0.0
    max_leaf_nodes: int | None = None
    max_features: int | float | None = None
    class_weight: str | dict | None = None
    missing: str = "ignore"             # ignore | drop | mean | median | zero | mode | category
    growth: str = "automatic"           # automatic | hybrid (half depth) | manual (root only)
    candidates: str = "exact"           # exact | approx
    category_search: str = "exhaustive"  # ordered | exhaustive | one_vs_rest
    seed: int = 42
    max_classes: int = 100
    max_categories: int = 10_000
    feature_batch: int = 16
    bucket_values: int = 10_000         # features with more distinct values are searched by buckets
    buckets: int = 1024                 # value buckets of such a feature, more for very large tables
    bucket_rows: int = 50_000_000       # rows a bucket may hold before more buckets are made

    @property
    def depth_limit(self) -> int:
        limits = {"automatic": self.max_depth, "hybrid": self.max_depth // 2, "manual": 0}
        if self.growth not in limits:
            raise ValueError(f"unknown growth mode {self.growth!r}")
        return limits[self.growth]


def feature_kinds(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Strings and named columns are categorical, everything else numeric."""
    return [(f, "categorical" if f in categorical or isinstance(field_type(df, f), T.StringType) else "numeric")
            for f in features]


def prepare(df: DataFrame, features: Sequence[tuple[str, str]], target: str, p: TreeParams,
            weight_col: str | None = None, positive: object = None, keep: Sequence[str] = ()
            ) -> tuple[DataFrame, list[str], str, list[float]]:
    """Typed features, class index and weight of the rows with a target.

    Returned with the class list, the positive class and the class totals.
    """
    names = [f for f, _ in features]
    measure(p.criterion)
    if p.missing == "category":
        df = df.withColumns({f: F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(MISSING))
                             for f, kind in features if kind == "categorical"})
    else:
        df = impute(df, names, p.missing)
    y = F.col(f"`{target}`")
    rows = df.where(y.isNotNull())
    weight = F.lit(1).cast("long") if weight_col is None else clean_double(df, weight_col)
    seen = (rows.groupBy(y.cast("string").alias("y")).agg(F.sum(weight).alias("w"))
            .limit(p.max_classes + 1).collect())
    if len(seen) > p.max_classes:
        raise ValueError(f"target {target!r} has more than {p.max_classes} classes")
    classes = sorted(r["y"] for r in seen)
    if not classes:
        raise ValueError("no rows with a target")
    totals = {r["y"]: float(r["w"] or 0.0) for r in seen}
    factor = {}
    if p.class_weight is not None:
        if p.class_weight == "balanced":
            n = sum(totals.values())
            factor = {c: n / (len(classes) * totals[c]) for c in classes}
        else:
            factor = {str(c): float(v) for c, v in p.class_weight.items()}
        table = F.create_map(*[F.lit(x) for c in classes for x in (c, factor.get(c, 1.0))])
        weight = weight * table[y.cast("string")]
    index = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    columns = [(clean_double(df, f) if kind == "numeric" else F.col(f"`{f}`").cast("string")).alias(f)
               for f, kind in features]
    data = rows.select(*keep, *columns, index[y.cast("string")].alias(CLASS), weight.alias(WEIGHT))
    at_root = [totals[c] * factor.get(c, 1.0) for c in classes]
    return data, classes, positive_class(classes, positive), at_root


MAX_SEARCH_BUCKETS = 16_384


@dataclass(frozen=True)
class Layout:
    """Facts about the features that shape the search, taken once per fit."""
    grid: dict[int, list[float]]            # fixed thresholds, when asked for
    with_nulls: frozenset[int]
    bucketed: frozenset[int]                # features with a prepared bucket column
    most_buckets: int = 1                   # buckets of a feature, the one of NULL included


def lay_out(data: DataFrame, features: Sequence[tuple[str, str]], p: TreeParams) -> tuple[DataFrame, Layout]:
    """Nulls, distinct values (estimated) and categories of all features in one pass.

    Category lists become part of the model, so more than ``max_categories``
    raises (after an exact count). Numeric features with many values get a
    bucket column between sketched quantiles; it is computed once here and not
    again at every level.
    """
    stats = {"rows": F.count(F.lit(1))}
    for i, (f, kind) in enumerate(features):
        c = F.col(f"`{f}`")
        stats[f"n{i}"] = F.count_if(c.isNull())
        stats[f"d{i}"] = F.approx_count_distinct(c)
    s = one_row(data, stats)
    suspects = [f for i, (f, kind) in enumerate(features)
                if kind == "categorical" and s[f"d{i}"] * 1.2 > p.max_categories]
    if suspects:
        for f, n in one_row(data, {f: F.count_distinct(F.col(f"`{f}`")) for f in suspects}).items():
            if n > p.max_categories:
                raise ValueError(f"{f!r} has {n} categories, over max_categories={p.max_categories}")
    numeric = [(i, f) for i, (f, kind) in enumerate(features) if kind == "numeric"]
    with_nulls = frozenset(i for i in range(len(features)) if s[f"n{i}"])
    if p.candidates == "approx":
        return data, Layout(approx_grid(data, numeric), with_nulls, frozenset())
    many = [(i, f) for i, f in numeric if s[f"d{i}"] > p.bucket_values]
    if many:
        k = min(MAX_SEARCH_BUCKETS, max(p.buckets, s["rows"] // p.bucket_rows))
        probs = [j / k for j in range(1, k)]
        # the cuts only steer the search, its result is exact for any cuts: a sample will do
        part = data.sample(fraction=min(1.0, 200.0 * k / s["rows"]), seed=p.seed)
        cuts = one_row(part, {f: F.percentile_approx(F.col(f"`{f}`"), probs, max(10_000, 10 * k)) for _, f in many})
        data = data.withColumns({bucket_column(i): bucket_of(F.col(f"`{f}`"), sorted(set(cuts[f] or []))) for i, f in many})
    return data, Layout({}, with_nulls, frozenset(i for i, _ in many), k + 1 if many else 1)


def approx_grid(data: DataFrame, numeric: Sequence[tuple[int, str]]) -> dict[int, list[float]]:
    """Few thresholds per feature: quantiles when skewed, points around the middle
    half when there are outliers, otherwise evenly spaced midpoints."""
    names = [f for _, f in numeric]
    q = exact_quantiles(data, {f: (0.1, 0.25, 0.5, 0.75, 0.9) for f in names})
    stats = {}
    for f in names:
        q1, q3 = (q[f][1], q[f][3]) if q[f][0] is not None else (0.0, 0.0)
        x = F.col(f"`{f}`")
        stats[f"s:{f}"] = F.skewness(x)
        stats[f"o:{f}"] = F.count_if((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))
    s = one_row(data, stats)
    grid = {}
    for i, f in numeric:
        if q[f][0] is None:
            grid[i] = []
        elif abs(s[f"s:{f}"] or 0.0) >= 1.0:
            grid[i] = sorted(set(q[f]))
        elif s[f"o:{f}"]:
            q1, q3 = q[f][1], q[f][3]
            low, high = q1 - 0.5 * (q3 - q1), q3 + 0.5 * (q3 - q1)
            grid[i] = sorted({low + (high - low) * j / 9 for j in range(10)})
        else:
            grid[i] = _spaced_midpoints(data, f)
    return grid


def _spaced_midpoints(data: DataFrame, f: str, limit: int = 50) -> list[float]:
    """Up to ``limit`` midpoints of neighbouring distinct values, evenly spaced by rank."""
    values = data.where(F.col(f"`{f}`").isNotNull()).select(F.col(f"`{f}`").alias("value")).distinct().withColumn(
        "n", F.lit(1)).persist()
    d = values.count()
    if d < 2:
        return []
    m = min(limit, d - 1)
    places = list(range(d - 1)) if m <= 10 else sorted({int(j * (d - 2) / (m - 1)) for j in range(m)})
    ranked = running_sums(values, "value", ["n"], value_edges(values, "value", d))
    need = sorted({r for p in places for r in (p, p + 1)})
    at = {r["cum_n"] - 1: r["value"] for r in ranked.where((F.col("cum_n") - 1).isin(need)).collect()}
    values.unpersist()
    return [(at[p] + at[p + 1]) / 2.0 for p in places]


def group_totals(data: DataFrame, groups: Sequence[Sequence[float]], exact: bool) -> DataFrame:
    """Class totals of the open groups, from numbers the driver already holds."""
    k = len(groups[0])
    kind = pa.int64() if exact else pa.float64()
    rows = [{GROUP: g, **{f"t{i}": int(c) if exact else float(c) for i, c in enumerate(counts)}}
            for g, counts in enumerate(groups)]
    return local_table(data.sparkSession, rows, pa.schema([(GROUP, pa.int32()), *[(f"t{i}", kind) for i in range(k)]]))


@dataclass(frozen=True)
class Found:
    """The best split of one group, with the class counts left, right and missing."""
    gain: float
    feature: int
    split: Split
    left: tuple[float, ...]
    right: tuple[float, ...]
    nulls: tuple[float, ...]

    @property
    def children(self) -> list[tuple[float, ...]]:
        kids = [list(self.left), list(self.right)]
        kids[self.split.missing_child] = [a + b for a, b in zip(kids[self.split.missing_child], self.nulls)]
        return [tuple(c) for c in kids]


def search(data: DataFrame, features: Sequence[tuple[str, str]], k: int, positive: int, totals: DataFrame,
           p: TreeParams, layout: Layout, groups: int, allowed: Sequence[Sequence[int]] | None = None, per_feature: bool = False) -> dict[int, list[Found]]:
    """Best splits per group; with ``per_feature`` one for every feature."""
    by = [GROUP, FEATURE] if per_feature else [GROUP]
    used = None if allowed is None else {i for m in allowed for i in m}
    numeric = [(i, f) for i, (f, kind) in enumerate(features)
               if kind == "numeric" and (used is None or i in used) and layout.grid.get(i, True)]
    text = [(i, f) for i, (f, kind) in enumerate(features) if kind == "categorical" and (used is None or i in used)]
    found: dict[int, list[Found]] = {}

    def collect(table: DataFrame, numeric_rows: bool) -> None:
        for r in table.collect():
            left = tuple(float(r[f"l{i}"]) for i in range(k))
            right = tuple(float(r[f"r{i}"]) for i in range(k))
            miss = 0 if sum(left) >= sum(right) else 1
            name = features[r[FEATURE]][0]
            if numeric_rows:
                split = Split(name, "numeric", "<=", float(r["threshold"]), missing_child=miss)
            else:
                cats = [(c, 0) for c in r["left"]] + [(c, 1) for c in r["right"]]
                split = Split(name, "categorical", categories=tuple(sorted(cats)), missing_child=miss)
            found.setdefault(r[GROUP], []).append(Found(
                float(r["gain"]), r[FEATURE], split, left, right, tuple(float(r[f"m{i}"]) for i in range(k))))

    for start in range(0, len(numeric), p.feature_batch):
        part = [(i, F.col(f"`{f}`")) for i, f in numeric[start:start + p.feature_batch]]
        if any(i in layout.bucketed for i, _ in part):
            best, table = best_numeric_bucketed(data, part, k, totals, p.criterion, p.min_samples_leaf, allowed, by,
                                                groups * len(part) * layout.most_buckets)
            collect(best, True)
            table.unpersist()
            continue
        cand = numeric_candidates(data, part, k, totals, p.criterion, p.min_samples_leaf,
                                  {i: layout.grid[i] for i, _ in part if i in layout.grid}, allowed,
                                  any(i in layout.with_nulls for i, _ in part))
        collect(best_numeric(cand, k, by), True)
    for start in range(0, len(text), p.feature_batch):
        part = text[start:start + p.feature_batch]
        collect(best_categorical(data, [(i, F.col(f"`{f}`")) for i, f in part], k, positive, totals, p.criterion,
                                 p.min_samples_leaf, p.category_search, allowed, by), False)
    return {g: sorted(rows, key=lambda r: (-round(r.gain, 12), r.feature)) for g, rows in found.items()}


def _feature_sample(p: TreeParams, count: int, rep: int, node_id: int,
                    importance: dict[int, float] | None) -> list[int]:
    """Features one node may use: all, or the smallest draws (half by importance once known)."""
    if p.max_features is None:
        return list(range(count))
    m = int(p.max_features * count) if isinstance(p.max_features, float) else p.max_features
    m = max(1, min(count, m))
    first = []
    if importance:
        first = sorted(importance, key=lambda i: (-importance[i], i))[:m // 2]
    rest = sorted((i for i in range(count) if i not in first), key=lambda i: draw_text(p.seed, rep, node_id, i))
    return sorted(first + rest[:m - len(first)])


def _grouped(data: DataFrame, models: dict[int, TreeModel], open_nodes: list[tuple[int, int]], rep_col: str | None) -> DataFrame:
    """Rows of the open nodes with their group number; all other rows are left out."""
    group = {key: g for g, key in enumerate(open_nodes)}
    out = []
    large = []
    for rep, model in models.items():
        if not any(r == rep for r, _ in open_nodes):
            continue
        if len(model.leaves()) > CASE_LEAVES:
            large.append(rep)
            continue
        out.append((rep, model.route(
            model.inputs(data), lambda n, r=rep: F.lit(group.get((r, n.node_id))).cast("int"))))
    parts = []
    if out:
        if rep_col is None:
            only_root = not models[out[0][0]].internal()
            parts.append(data.withColumn(GROUP, F.col(ROOT_GROUP) if only_root else out[0][1]))
        else:
            expr = None
            for rep, route in out:
                hit = F.col(rep_col) == rep
                expr = F.when(hit, route) if expr is None else expr.when(hit, route)
            parts.append(data.withColumn(GROUP, expr))
    for rep in large:
        rows = data if rep_col is None else data.where(F.col(rep_col) == rep)
        table = local_table(data.sparkSession, [
            {"_leaf": n, GROUP: g} for (r, n), g in group.items() if r == rep],
            pa.schema([("_leaf", pa.int64()), (GROUP, pa.int32())]))
        parts.append(assign_leaf(rows, models[rep], "_leaf").join(F.broadcast(table), "_leaf").drop("_leaf"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.where(F.col(GROUP).isNotNull())


def grow(data: DataFrame, features: Sequence[tuple[str, str]], classes: Sequence[str], positive: str, target: str,
         p: TreeParams, layout: Layout | None, at_root: dict[int, Sequence[float]], rep_col: str | None = None,
         importance: dict[str, float] | None = None) -> dict[int, TreeModel]:
    """Grow one tree per replicate; all replicates share the job of a level."""
    k = len(classes)
    exact = not isinstance(data.schema[WEIGHT].dataType, T.DoubleType)
    models = {r: TreeModel({ROOT: Node(ROOT, None, 0, 0, tuple(at_root[r]))}, tuple(classes), positive, target,
                           tuple(features), p.criterion, {"params": p}) for r in at_root}
    if p.depth_limit <= 0:
        return models
    by_index = {i: importance.get(f, 0.0) for i, (f, _) in enumerate(features)} if importance else None

    def is_open(model: TreeModel, node: Node) -> bool:
        return (node.depth < p.depth_limit and node.n >= p.min_samples_split
                and sum(c > 0 for c in node.counts) > 1 and impurity_of(node.counts, p.criterion) > PURE)

    open_nodes = [(r, ROOT) for r in models if is_open(models[r], models[r].nodes[ROOT])]
    while open_nodes:
        allowed = None
        if p.max_features is not None:
            allowed = [_feature_sample(p, len(features), r, n, by_index) for r, n in open_nodes]
        routed = _grouped(data, models, open_nodes, rep_col)
        totals = group_totals(data, [models[r].nodes[n].counts for r, n in open_nodes], exact)
        found = search(routed, features, k, list(classes).index(positive), totals, p, layout,
                       len(open_nodes), allowed)
        fresh = []
        for g, (r, n) in enumerate(open_nodes):
            if p.max_leaf_nodes is not None and len(models[r].leaves()) >= p.max_leaf_nodes:
                continue
            best = found.get(g, [None])[0]
            if best is None or best.gain <= max(p.min_impurity_decrease, 0.0):
                continue
            models[r] = models[r].with_split(n, best.split, best.children)
            fresh += [(r, c.node_id) for c in models[r].children(n)]
        open_nodes = [(r, n) for r, n in fresh if is_open(models[r], models[r].nodes[n])]
    return models


@contextmanager
def laid_out(df: DataFrame, features: Sequence[tuple[str, str]], target: str, p: TreeParams,
             weight_col: str | None = None, positive: object = None, keep: Sequence[str] = (), once: bool = False):
    """Prepared and bucketed rows with all that a search needs; persisted, and released at the end.

    A small table is spread over the cores and kept while its layout is found. A larger one that is searched only
    ``once`` is not kept: a search reads the columns of one batch of features at a time, a kept partition all of them.
    """
    data, classes, pos, at_root = prepare(df, features, target, p, weight_col, positive, keep)
    small = is_small(data)
    first = spread(data).persist() if small else data
    kept = first
    try:
        ready, layout = lay_out(first, features, p)
        if once and not small:
            # never 1, but no constant either (see below)
            yield ready.withColumn(ROOT_GROUP, F.when(F.col(CLASS) < 0, 1).otherwise(0)), layout, classes, pos, at_root
            return
        # the group of the root is a stored column: as a constant it would turn
        # the equi-joins of the search into nested loops
        kept = ready.withColumn(ROOT_GROUP, F.lit(0)).persist()
        yield kept, layout, classes, pos, at_root
    finally:
        kept.unpersist()
        first.unpersist()


def fit(df: DataFrame, features: Sequence[str], target: str, categorical: Sequence[str] = (),
        weight_col: str | None = None, positive: object = None, importance: dict[str, float] | None = None,
        **params) -> TreeModel:
    """Grow a tree on ``df``; see :class:`TreeParams` for the parameters."""
    p = TreeParams(**params)
    kinds = feature_kinds(df, features, categorical)
    types = {f: t for f, kind in kinds if kind == "numeric" and (t := field_type(df, f).simpleString()) in TYPED}

    def typed(model: TreeModel) -> TreeModel:
        return replace(model, params={**model.params, "types": types}) if types else model

    if p.depth_limit <= 0:
        data, classes, pos, at_root = prepare(df, kinds, target, p, weight_col, positive)
        return typed(grow(data, kinds, classes, pos, target, p, None, {0: at_root})[0])
    with laid_out(df, kinds, target, p, weight_col, positive) as (data, layout, classes, pos, at_root):
        return typed(grow(data, kinds, classes, pos, target, p, layout, {0: at_root}, importance=importance)[0])


# --- one node ------------------------------------------------------------

SPLIT_SCHEMA = pa.schema([
    ("feature", pa.string()), ("split_type", pa.string()), ("threshold", pa.float64()),
    ("left_categories", pa.list_(pa.string())), ("right_categories", pa.list_(pa.string())), ("gain", pa.float64()),
    ("n_left", pa.float64()), ("n_right", pa.float64()), ("n_missing", pa.float64()), ("coverage", pa.float64()),
    ("left_counts", pa.map_(pa.string(), pa.float64())), ("right_counts", pa.map_(pa.string(), pa.float64())),
    ("missing_child", pa.int32())])


def _split_row(f: Found, classes: Sequence[str]) -> dict:
    n = sum(f.left) + sum(f.right)
    numeric = f.split.kind == "numeric"
    return {"feature": f.split.feature, "split_type": f.split.kind, "threshold": f.split.value,
            "left_categories": None if numeric else f.split.members(0),
            "right_categories": None if numeric else f.split.members(1), "gain": f.gain,
            "n_left": sum(f.left), "n_right": sum(f.right), "n_missing": sum(f.nulls),
            "coverage": n / (n + sum(f.nulls)), "left_counts": list(zip(classes, f.left)),
            "right_counts": list(zip(classes, f.right)), "missing_child": f.split.missing_child}


def best_splits(df: DataFrame, features: Sequence[str], target: str, categorical: Sequence[str] = (),
                weight_col: str | None = None, positive: object = None, **params) -> tuple[list[str], list[Found]]:
    """The classes and the best split of every feature over the rows given, best first."""
    p = TreeParams(**params)
    kinds = feature_kinds(df, features, categorical)
    with laid_out(df, kinds, target, p, weight_col, positive, once=True) as (data, layout, classes, pos, counts):
        exact = not isinstance(data.schema[WEIGHT].dataType, T.DoubleType)
        found = search(data.withColumn(GROUP, F.col(ROOT_GROUP)), kinds, len(classes), classes.index(pos),
                       group_totals(data, [counts], exact), p, layout, 1, per_feature=True)
        return classes, found.get(0, [])


def split_table(df: DataFrame, features: Sequence[str], target: str, top: int | None = None, **kw) -> DataFrame:
    """Best split of each feature (of the ``top`` best ones) as a table, ranked by gain, with class counts and coverage."""
    classes, found = best_splits(df, features, target, **kw)
    return local_table(df.sparkSession, [_split_row(f, classes) for f in found[:top]], SPLIT_SCHEMA)


def best_numeric_split(df: DataFrame, features: Sequence[str], target: str, **kw) -> DataFrame:
    """Best threshold of each numeric feature, best feature first."""
    return split_table(df, features, target, **kw)


def best_categorical_split(df: DataFrame, features: Sequence[str], target: str, **kw) -> DataFrame:
    """Best two-way division of the categories of each feature, best feature first."""
    return split_table(df, features, target, categorical=features, **kw)


def split_candidates(df: DataFrame, model: TreeModel, node_id: int, top: int | None = 50, **params) -> DataFrame:
    """The ``top`` best splits available at a node of a model, ranked by gain; ``top=None`` gives all."""
    rows = df.where(model.where(df, node_id))
    return split_table(rows, [f for f, _ in model.features], model.target, top,
                       categorical=[f for f, kind in model.features if kind == "categorical"],
                       **{"criterion": model.criterion, **params})


def suggest_splits(df: DataFrame, features: Sequence[str], target: str, categorical: Sequence[str] = ()) -> DataFrame:
    """Plain suggestions when no split gains: median per numeric feature, most
    frequent category against the rest; a side left empty drops the suggestion."""
    kinds = feature_kinds(df, features, categorical)
    rows = df.where(F.col(f"`{target}`").isNotNull())
    numeric = [f for f, kind in kinds if kind == "numeric"]
    medians = {f: q[0] for f, q in exact_quantiles(rows, {f: (0.5,) for f in numeric}).items() if q[0] is not None}
    tops = modes(rows, [f for f, kind in kinds if kind == "categorical"])
    out = []
    for f, kind in kinds:
        if kind == "numeric" and f in medians:
            x = clean_double(rows, f)
            left, filled, value, word = F.count_if(x <= medians[f]), F.count(x), medians[f], None
        elif kind == "categorical" and tops.get(f) is not None:
            c = F.col(f"`{f}`").cast("string")
            left, filled, value, word = F.count_if(c == str(tops[f])), F.count(c), None, str(tops[f])
        else:
            continue
        out.append((f, {"split_type": F.first(F.lit(kind)), "threshold": F.max(F.lit(value).cast("double")),
                        "category": F.max(F.lit(word).cast("string")), "n_left": left, "n_right": filled - left}))
    return long_stats(rows, dict(out)).where("n_left > 0 AND n_right > 0")


def quick_screen(df: DataFrame, features: Sequence[str], target: str, categorical: Sequence[str] = (),
                 top: int | None = None, max_classes: int = 100) -> DataFrame:
    """Gini gain of the median split, or of the first half of the sorted categories (the ``top`` best features).

    All features share two aggregations: one for the medians, one for the
    class counts of every side.
    """
    kinds = feature_kinds(df, features, categorical)
    data, classes, _, _ = prepare(df, kinds, target, TreeParams(max_classes=max_classes))
    numeric = [f for f, kind in kinds if kind == "numeric"]
    medians = {f: q[0] for f, q in exact_quantiles(data, {f: (0.5,) for f in numeric}).items()}
    sides = {}
    for f, kind in kinds:
        x = F.col(f"`{f}`")
        if kind == "numeric":
            if medians[f] is not None:
                sides[f] = (x <= medians[f], x.isNotNull())
        else:
            cats = levels(data, f, 10_000)
            if len(cats) >= 2:
                sides[f] = (x.isin(cats[:len(cats) // 2]), x.isNotNull())
    stats = {f: {**{f"l{i}": F.sum(F.when(left & (F.col(CLASS) == i), 1).otherwise(0)) for i in range(len(classes))},
                 **{f"r{i}": F.sum(F.when(~left & known & (F.col(CLASS) == i), 1).otherwise(0))
                    for i in range(len(classes))}} for f, (left, known) in sides.items()}
    t = long_stats(data, stats)
    left = [f"CAST(l{i} AS DOUBLE)" for i in range(len(classes))]
    right = [f"CAST(r{i} AS DOUBLE)" for i in range(len(classes))]
    n_left = F.expr(" + ".join(f"l{i}" for i in range(len(classes))))
    n_right = F.expr(" + ".join(f"r{i}" for i in range(len(classes))))
    cuts = F.create_map(*[F.lit(v) for f in sides for v in (f, medians.get(f))]) if sides else F.lit(None)
    ranked = (t.where((n_left > 0) & (n_right > 0))
            .select("feature", cuts[F.col("feature")].cast("double").alias("threshold"),
                    n_left.alias("n_left"), n_right.alias("n_right"), F.expr(gain_sql(left, right, "gini")).alias("gain"))
            .where("gain > 0").orderBy(F.desc(F.round("gain", 12)), "feature"))
    return ranked if top is None else ranked.limit(top)
