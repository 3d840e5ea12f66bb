"""Pruning: one counted (or weighed) pass over the data, then a fold over the node table."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from timberline.core import local_table
from timberline.operators.nodecounts import counts_by_node, recounted, without_unseen
from timberline.plans.tree import ROOT, TreeModel

# Confidence level and normal quantile used for it and above.
Z_VALUES = ((0.999, 3.291), (0.99, 2.576), (0.95, 1.96), (0.90, 1.645), (0.80, 1.282), (0.50, 0.674), (0.0, 0.0))

# 20 log-spaced alphas from 1e-10 to 1.
ALPHAS = tuple(10.0 ** (-10.0 + 10.0 * i / 19.0) for i in range(20))


def leaves_under(model: TreeModel, node_id: int) -> list[int]:
    if model.nodes[node_id].split is None:
        return [node_id]
    return [d for d in model.descendants(node_id) if model.nodes[d].split is None]


def prunable(model: TreeModel) -> list[int]:
    """Internal nodes except the root, deepest first."""
    return [n.node_id for n in sorted(model.internal(), key=lambda n: (-n.depth, n.node_id)) if n.node_id != ROOT]


def link_strength(model: TreeModel, node_id: int) -> float:
    """(node impurity - leaf-weighted impurity) / (leaves - 1)."""
    leaves = leaves_under(model, node_id)
    n = sum(model.nodes[i].n for i in leaves)
    below = sum(model.impurity(i) * model.nodes[i].n for i in leaves) / n if n else 0.0
    return (model.impurity(node_id) - below) / max(1, len(leaves) - 1)


def _cut(model: TreeModel, alpha: float) -> TreeModel:
    for i in prunable(model):
        if i in model.nodes and link_strength(model, i) < alpha:
            model = model.collapsed([i])
    return model


def prune_cc(model: TreeModel, df: DataFrame | None = None, alpha: float = 0.01, weight_col: str | None = None) -> TreeModel:
    """Collapse nodes whose link strength is below alpha, deepest first, never the root.

    With ``df`` the counts of the model are taken anew from that data first; rows of classes the model does not know
    count as one class of their own.
    """
    return without_unseen(_cut(recounted(model, counts_by_node(df, model, weight_col)) if df is not None else model, alpha))


def _correct(model: TreeModel, counted: dict[int, tuple[float, ...]], node_ids) -> float:
    return sum(counted[i][model.classes.index(model.prediction(i))] for i in node_ids)


def prune_cc_search(model: TreeModel, df: DataFrame, weight_col: str | None = None) -> tuple[TreeModel, DataFrame]:
    """Best of 20 alphas by accuracy on ``df`` (the smallest on ties), with the table of trials.

    The data are counted once; every trial re-adds the counts of its leaves.
    """
    counted = counts_by_node(df, model, weight_col)
    total = sum(counted[ROOT])
    best, trials = None, []
    for alpha in ALPHAS:
        tree = _cut(model, alpha)
        leaves = [n.node_id for n in tree.leaves()]
        acc = _correct(tree, counted, leaves) / total if total else 0.0
        trials.append({"alpha": alpha, "leaves": len(leaves), "accuracy": acc})
        if best is None or acc > best[0]:
            best = (acc, tree)
    return best[1], local_table(df.sparkSession, trials, pa.schema(
        [("alpha", pa.float64()), ("leaves", pa.int64()), ("accuracy", pa.float64())]))


def prune_path(model: TreeModel, df: DataFrame | None = None, weight_col: str | None = None) -> list[tuple[float, TreeModel]]:
    """Weakest-link path: ``(alpha, tree)`` from the full tree to the root's children."""
    tree = recounted(model, counts_by_node(df, model, weight_col)) if df is not None else model
    path = [(0.0, without_unseen(tree))]
    while prunable(tree):
        strength = {i: link_strength(tree, i) for i in prunable(tree)}
        alpha = min(strength.values())
        tree = tree.collapsed(i for i, s in strength.items() if s == alpha)
        path.append((alpha, without_unseen(tree)))
    return path


def path_table(spark, path: list[tuple[float, TreeModel]]) -> DataFrame:
    rows = [{"step": i, "alpha": a, "leaves": len(t.leaves()), "nodes": len(t.nodes)} for i, (a, t) in enumerate(path)]
    return local_table(spark, rows, pa.schema(
        [("step", pa.int32()), ("alpha", pa.float64()), ("leaves", pa.int64()), ("nodes", pa.int64())]))


def prune_reduced_error(model: TreeModel, valid: DataFrame, weight_col: str | None = None) -> TreeModel:
    """Collapse a node when that does not lower accuracy on held-out rows."""
    counted = counts_by_node(valid, model, weight_col)
    for i in prunable(model):
        if _correct(model, counted, [i]) >= _correct(model, counted, leaves_under(model, i)):
            model = model.collapsed([i])
    return model


def _margin(n: float, confidence: float) -> float:
    z = next(z for level, z in Z_VALUES if confidence >= level)
    return z * math.sqrt(0.25 / n) if n > 0 else 1.0


def prune_error_based(model: TreeModel, df: DataFrame, confidence: float = 0.25, weight_col: str | None = None) -> TreeModel:
    """Collapse a node when its error estimate is not above that of its leaves on ``df``."""
    counted = counts_by_node(df, model, weight_col)
    for i in prunable(model):
        node = model.nodes[i]
        own = 1.0 - max(node.counts) / node.n + _margin(node.n, confidence) if node.n else 1.0
        errors = weight = 0.0
        for leaf in leaves_under(model, i):
            n = sum(counted[leaf])
            if n:
                wrong = 1.0 - _correct(model, counted, [leaf]) / n
                errors += (wrong + _margin(n, confidence)) * n
                weight += n
        if own <= (errors / weight if weight else 1.0):
            model = model.collapsed([i])
    return model


def holdout(df: DataFrame, key, share: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows) by a deterministic draw per key."""
    from timberline.operators.ordering import uniform
    u = uniform(key, seed)
    return df.where(u >= share), df.where(u < share)
