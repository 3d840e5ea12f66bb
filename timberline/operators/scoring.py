"""Routing rows to leaves and scoring them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.core import local_table
from timberline.operators.missing import MISSING
from timberline.plans.tree import ROOT, TreeModel

# Above this many leaves a join per level is faster than one nested CASE.
CASE_LEAVES = 256


def assign_leaf(df: DataFrame, model: TreeModel, name: str = "leaf_id", case_leaves: int = CASE_LEAVES) -> DataFrame:
    """Add the id of the leaf each row falls into."""
    if len(model.leaves()) <= max(case_leaves, 1):
        return df.withColumn(name, model.route(model.inputs(df)))
    return _assign_by_level(df, model, name)


def _assign_by_level(df: DataFrame, model: TreeModel, name: str) -> DataFrame:
    """One broadcast join with the node table per level.

    The node table comes from the driver, so its size is that of the model.
    """
    inputs = model.inputs(df)
    splits = {n.split.feature: n.split for n in model.internal()}
    numeric = [f for f in inputs if not splits[f].is_categorical]
    text = [f for f in inputs if splits[f].is_categorical]
    kids = model.child_map()
    rows = []
    for n in model.internal():
        s = n.split
        flip = s.kind == "numeric" and s.op in (">", ">=")
        rows.append({
            "_nid": n.node_id, "_text": s.is_categorical,
            "_fi": (text if s.is_categorical else numeric).index(s.feature) + 1,
            "_t": list(s.thresholds) if s.kind == "numeric_multi_bin" else [s.value] if s.kind == "numeric" else [],
            # x <= t and x > t put t itself below the cut; x < t and x >= t above it
            "_closed": s.kind == "numeric" and s.op in ("<=", ">"), "_flip": flip,
            "_cats": list(s.categories), "_null": any(c == MISSING for c, _ in s.categories),
            "_miss": s.missing_child, "_kids": [c.node_id for c in kids[n.node_id]]})
    nodes = local_table(df.sparkSession, rows, pa.schema([
        ("_nid", pa.int64()), ("_text", pa.bool_()), ("_fi", pa.int32()), ("_t", pa.list_(pa.float64())),
        ("_closed", pa.bool_()), ("_flip", pa.bool_()), ("_cats", pa.map_(pa.string(), pa.int32())),
        ("_null", pa.bool_()), ("_miss", pa.int32()), ("_kids", pa.list_(pa.int64()))]))
    out = df.withColumns({
        "_num": F.array(*[inputs[f] for f in numeric]) if numeric else F.array(F.lit(None).cast("double")),
        "_str": F.array(*[inputs[f] for f in text]) if text else F.array(F.lit(None).cast("string")),
        # the root's split is applied directly; joins start at its children
        name: model.nodes[ROOT].split.branch(inputs[model.nodes[ROOT].split.feature], [
            F.lit(c.node_id).cast("long") for c in kids[ROOT]])})
    keep = out.columns
    x, s = F.get("_num", F.col("_fi") - 1), F.get("_str", F.col("_fi") - 1)
    below = F.size(F.filter("_t", lambda t: F.when(F.col("_closed"), t < x).otherwise(t <= x)))
    by_number = F.when(x.isNotNull(), F.when(F.col("_flip"), 1 - below).otherwise(below))
    word = F.when(F.col("_null"), F.coalesce(s, F.lit(MISSING))).otherwise(s)
    by_text = F.when(word.isNotNull(), F.try_element_at("_cats", F.coalesce(word, F.lit(""))))
    child = F.coalesce(F.when(F.col("_text"), by_text).otherwise(by_number), F.col("_miss"))
    for _ in range(model.depth - 1):
        joined = out.join(F.broadcast(nodes), F.col(name) == F.col("_nid"), "left")
        step = F.when(F.col("_nid").isNull(), F.col(name)).otherwise(F.get("_kids", child))
        out = joined.withColumn(name, step).select(*keep)
    return out.drop("_num", "_str")


def leaf_table(df: DataFrame, model: TreeModel) -> DataFrame:
    """The columns scoring needs, one row per node of the model."""
    return model.to_df(df.sparkSession).select(
        F.col("node_id").alias("leaf_id"), "prediction", "probability", "p_positive", "class_counts",
        "n", "path", "rule")


def predict(df: DataFrame, model: TreeModel, threshold: float | None = None, name: str = "prediction",
            keep_leaf: bool = True) -> DataFrame:
    """Leaf majority, or positive where the leaf's positive share reaches ``threshold``.

    Adds the leaf id, the positive probability ``p`` and the prediction, which
    come from a broadcast of the node table (one row per node of the model).
    """
    routed = assign_leaf(df, model)
    if threshold is None:
        label = F.col("_l")
    else:
        others = [c for c in model.classes if c != model.positive]
        negative = others[0] if len(others) == 1 else None
        if negative is None:
            raise ValueError("a threshold needs exactly two classes")
        label = F.when(F.col("p") >= threshold, model.positive).otherwise(negative)
    leaves = leaf_table(df, model).select("leaf_id", F.col("p_positive").alias("p"), F.col("prediction").alias("_l"))
    out = routed.join(F.broadcast(leaves), "leaf_id", "left").withColumn(name, label).drop("_l")
    return out if keep_leaf else out.drop("leaf_id")


def predict_proba(df: DataFrame, model: TreeModel) -> DataFrame:
    """Adds one probability column ``p_<class>`` per class."""
    leaves = leaf_table(df, model).select("leaf_id", *[
        F.try_divide(F.element_at("class_counts", F.lit(c)), F.col("n")).alias(f"p_{c}") for c in model.classes])
    return assign_leaf(df, model).join(F.broadcast(leaves), "leaf_id", "left")


def score(df: DataFrame, model: TreeModel) -> DataFrame:
    """Adds leaf id, path, rule text, prediction and positive probability."""
    leaves = leaf_table(df, model).select(
        "leaf_id", "path", "rule", "prediction", F.col("p_positive").alias("p"))
    return assign_leaf(df, model).join(F.broadcast(leaves), "leaf_id", "left")
