"""The one data pass behind reports, pruning and importance: class counts per node."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.core import clean_double
from timberline.operators.scoring import assign_leaf
from timberline.plans.tree import TreeModel


def leaf_class_counts(df: DataFrame, model: TreeModel, target: str | None = None,
                      weight_col: str | None = None) -> DataFrame:
    """``(leaf_id, y, n)``: rows (or weights) per leaf and class — at most leaves x classes rows."""
    y = F.col(f"`{target or model.target}`")
    n = F.count(F.lit(1)) if weight_col is None else F.sum(clean_double(df, weight_col))
    routed = assign_leaf(df.where(y.isNotNull()), model)
    return routed.groupBy("leaf_id", y.cast("string").alias("y")).agg(n.alias("n"))


def node_class_counts(df: DataFrame, model: TreeModel, target: str | None = None,
                      weight_col: str | None = None) -> DataFrame:
    """``(node_id, y, n)`` for every node: leaf counts spread over their ancestors.

    Rows are counted per leaf first, so the ancestor join sees only the small
    leaf table.
    """
    leaves = leaf_class_counts(df, model, target, weight_col)
    paths = model.ancestor_table(df.sparkSession).select("leaf_id", "node_id")
    return leaves.join(F.broadcast(paths), "leaf_id").groupBy("node_id", "y").agg(F.sum("n").alias("n"))


def counts_by_node(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> dict[int, tuple[float, ...]]:
    """Class counts of every node on the driver, and last the rows of all classes the model does not know.

    Unknown classes are one group before the collect: at most leaves x (classes + 1) numbers.
    """
    k = len(model.classes)
    index = {c: i for i, c in enumerate(model.classes)}
    counts = leaf_class_counts(df, model, weight_col=weight_col)
    known = F.when(F.col("y").isin(list(model.classes)), F.col("y"))
    leaf: dict[int, list[float]] = {}
    for r in counts.groupBy("leaf_id", known.alias("y")).agg(F.sum("n").alias("n")).collect():
        leaf.setdefault(r["leaf_id"], [0.0] * (k + 1))[index.get(r["y"], k)] += float(r["n"])
    out: dict[int, list[float]] = {i: [0.0] * (k + 1) for i in model.nodes}
    for leaf_id, counts in leaf.items():
        for a in model.ancestors(leaf_id):
            out[a] = [x + y for x, y in zip(out[a], counts)]
    return {i: tuple(c) for i, c in out.items()}


UNSEEN = "(unseen)"


def recounted(model: TreeModel, counts: dict[int, tuple[float, ...]]) -> TreeModel:
    """The model with the counts of ``counts_by_node``; rows of unknown classes become one more class."""
    if any(c[-1] for c in counts.values()):
        model = replace(model, classes=(*model.classes, UNSEEN))
    return model.with_counts({i: c[:len(model.classes)] for i, c in counts.items()})


def without_unseen(model: TreeModel) -> TreeModel:
    """The model with its own classes again."""
    if model.classes[-1] != UNSEEN:
        return model
    return replace(model, classes=model.classes[:-1]).with_counts({i: n.counts[:-1] for i, n in model.nodes.items()})


def pivoted(counts: DataFrame, model: TreeModel) -> DataFrame:
    """One row per node: ``c0…`` per class, ``cu`` for all classes the model does not know, and ``n`` of all rows;
    with the nodes that got no rows."""
    k = len(model.classes)
    wide = counts.groupBy("node_id").agg(*[
        F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(model.classes)],
        F.sum(F.when(F.col("y").isin(list(model.classes)), 0).otherwise(F.col("n"))).alias("cu"))
    nodes = model.to_df(counts.sparkSession).select(
        "node_id", "parent_id", "child_index", "depth", "is_terminal", "prediction", "path", "rule", "split_feature")
    joined = nodes.join(wide, "node_id", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in (*[f"c{i}" for i in range(k)], "cu")})
    return filled.withColumn("n", sum((F.col(f"c{i}") for i in range(1, k)), F.col("c0")) + F.col("cu"))


def class_columns(model: TreeModel) -> list[Column]:
    """Counts of the model's classes, then of all others."""
    return [*[F.col(f"c{i}") for i in range(len(model.classes))], F.col("cu")]
