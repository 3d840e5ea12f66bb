"""Manual splits, split and tree validation, node contents."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.core import clean_double, is_numeric, local_table, one_row
from timberline.functions.impurity import impurity_of
from timberline.operators.nodecounts import counts_by_node
from timberline.plans.tree import Split, TreeModel


def node_rows(df: DataFrame, model: TreeModel, node_id: int) -> DataFrame:
    """The rows of a node, as a predicate that is pushed to the file scan."""
    return df.where(model.where(df, node_id))


def apply_split(model: TreeModel, df: DataFrame, node_id: int, split: Split,
                min_samples_leaf: float = 1, weight_col: str | None = None) -> TreeModel:
    """Split a leaf by hand; one pass over its rows gives the child counts.

    NULL goes right in a two-way numeric split, unlisted categories go right in
    a two-way categorical split; otherwise both go to the largest child.
    """
    if model.nodes[node_id].split is not None:
        raise ValueError(f"node {node_id} is already split")
    y = F.col(f"`{model.target}`")
    rows = node_rows(df, model, node_id).where(y.isNotNull())
    child = split.child(model.input(df, split), unknown=-1)
    n = F.count(F.lit(1)) if weight_col is None else F.sum(clean_double(df, weight_col))
    # rows of classes the model does not know count for the sizes, the model keeps its own classes
    known = F.when(y.cast("string").isin(list(model.classes)), y.cast("string"))
    counts = rows.groupBy(child.alias("child"), known.alias("y")).agg(n.alias("n")).collect()
    k = len(model.classes)
    index = {c: i for i, c in enumerate(model.classes)}
    table = {i: [0.0] * (k + 1) for i in range(-1, split.width)}
    for r in counts:
        table[r["child"]][index.get(r["y"], k)] += float(r["n"])
    if split.kind in ("numeric", "categorical"):
        missing = 1
    else:
        missing = max(range(split.width), key=lambda i: (sum(table[i]), -i))
    table[missing] = [a + b for a, b in zip(table[missing], table[-1])]
    children = [table[i] for i in range(split.width)]
    empty = [i for i, c in enumerate(children) if sum(c) < max(min_samples_leaf, 1e-12)]
    if empty:
        raise ValueError(f"split leaves children {empty} with fewer than {min_samples_leaf} rows")
    return model.with_split(node_id, replace(split, missing_child=missing), [c[:k] for c in children])


def validate_split(df: DataFrame, split: Split) -> DataFrame:
    """Check a split against data: type, threshold range, unlisted categories."""
    problems = []
    if split.feature not in df.columns:
        problems.append("unknown_feature")
    elif split.is_categorical:
        listed = [c for c, _ in split.categories]
        s = F.col(f"`{split.feature}`").cast("string")
        facts = one_row(df, {"unlisted": F.count_if(~s.isin(listed)), "rows": F.count(s)})
        if facts["unlisted"]:
            problems.append("unlisted_categories")
        if len({c for c, _ in split.categories}) < len(split.categories):
            problems.append("category_twice")
        if len({i for _, i in split.categories}) < 2 and not facts["unlisted"]:
            problems.append("one_child_only")
    elif not is_numeric(df, split.feature):
        problems.append("not_numeric")
    else:
        x = clean_double(df, split.feature)
        facts = one_row(df, {"lo": F.min(x), "hi": F.max(x)})
        cuts = [split.value] if split.kind == "numeric" else list(split.thresholds)
        if facts["lo"] is None:
            problems.append("no_values")
        elif any(not facts["lo"] <= c <= facts["hi"] for c in cuts):
            problems.append("threshold_out_of_range")
    return local_table(df.sparkSession, [{"feature": split.feature, "valid": not problems,
                                          "problems": ",".join(problems)}],
                       pa.schema([("feature", pa.string()), ("valid", pa.bool_()), ("problems", pa.string())]))


def validate_tree(model: TreeModel, df: DataFrame) -> DataFrame:
    """Per node: stored and counted rows, children adding up, depth, emptiness."""
    counted = counts_by_node(df, model)
    kids = model.child_map()
    rows = []
    for i, node in sorted(model.nodes.items()):
        n = sum(counted[i])
        below = [c.node_id for c in kids.get(i, [])]
        parent = model.nodes.get(node.parent_id) if node.parent_id is not None else None
        rows.append({
            "node_id": i, "stored_n": node.n, "counted_n": n, "counts_match": tuple(counted[i]) == (*node.counts, 0.0),
            "children_add_up": not below or sum(sum(counted[c]) for c in below) == n,
            "depth_ok": node.depth == (parent.depth + 1 if parent else 0),
            "children_ok": len(below) == (node.split.width if node.split else 0), "is_empty": n == 0})
    b = pa.bool_()
    return local_table(df.sparkSession, rows, pa.schema([
        ("node_id", pa.int64()), ("stored_n", pa.float64()), ("counted_n", pa.float64()), ("counts_match", b),
        ("children_add_up", b), ("depth_ok", b), ("children_ok", b), ("is_empty", b)]))


def split_analysis(df: DataFrame, model: TreeModel, node_id: int, value: str | None = None) -> DataFrame:
    """Per child of a node: size, share, class impurity, and mean/std/min/max of a
    numeric column (the target by default) with the variance reduction."""
    node = model.nodes[node_id]
    if node.split is None:
        raise ValueError(f"node {node_id} has no split")
    value = value or model.target
    rows = node_rows(df, model, node_id).where(F.col(f"`{model.target}`").isNotNull())
    x = clean_double(rows, value) if is_numeric(rows, value) else F.lit(None).cast("double")
    y = F.col(f"`{model.target}`").cast("string")
    per_child = rows.groupBy(node.split.child(model.input(rows, node.split)).alias("child")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(y == c).alias(f"c{i}") for i, c in enumerate(model.classes)],
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.var_samp(x).alias("var"), F.count(x).alias("k")).collect()
    total = sum(r["n"] for r in per_child)
    k = sum(r["k"] for r in per_child)
    centre = sum(r["mean"] * r["k"] for r in per_child if r["k"]) / k if k else 0.0
    spread = sum((r["var"] or 0.0) * (r["k"] - 1) + r["k"] * (r["mean"] - centre) ** 2 for r in per_child if r["k"])
    variance = spread / (k - 1) if k > 1 else None
    within = sum((r["var"] or 0.0) * r["n"] for r in per_child) / total if total else None
    largest = max((r["n"] for r in per_child), default=0)
    out = [{"child": r["child"], "n": r["n"], "pct": 100.0 * r["n"] / total,
            "balance": min(x["n"] for x in per_child) / largest,
            "class_counts": [(c, r[f"c{i}"]) for i, c in enumerate(model.classes)],
            "impurity": impurity_of([r[f"c{i}"] for i in range(len(model.classes))], model.criterion),
            **{c: r[c] for c in ("mean", "std", "min", "max")},
            "variance_reduction": None if variance is None else variance - within}
           for r in sorted(per_child, key=lambda r: r["child"])]
    f = pa.float64()
    return local_table(df.sparkSession, out, pa.schema([
        ("child", pa.int32()), ("n", pa.int64()), ("pct", f), ("balance", f),
        ("class_counts", pa.map_(pa.string(), pa.int64())), ("impurity", f), ("mean", f), ("std", f), ("min", f),
        ("max", f), ("variance_reduction", f)]))

