"""Reports on a tree, always computed from the rows given.

Rows are routed and counted once per leaf and class; everything else is SQL
over that small table. With ``weight_col`` all sizes are sums of weights.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.core import clean_double
from timberline.functions.impurity import impurity
from timberline.operators.nodecounts import class_columns, node_class_counts, pivoted
from timberline.operators.scoring import assign_leaf
from timberline.plans.tree import ROOT, TreeModel


def node_table(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """One row per node with counts, impurity, positives and hits of its prediction on ``df``."""
    nodes = pivoted(node_class_counts(df, model, weight_col=weight_col), model)
    positive = F.col(f"c{model.classes.index(model.positive)}")
    hits = reduce(lambda a, b: a + b, [F.when(F.col("prediction") == c, F.col(f"c{i}")).otherwise(0)
                                       for i, c in enumerate(model.classes)])
    return nodes.withColumns({"impurity": impurity(class_columns(model), model.criterion),
                              "positives": positive, "hits": hits})


def node_report(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Per leaf by falling size: rule, path, size, targets, rate, lift x 100 and running totals."""
    leaves = node_table(df, model, weight_col).where("is_terminal AND n > 0")
    whole = Window.partitionBy()
    order = Window.orderBy(F.desc("n"), "node_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    size, hits = F.sum("n").over(run), F.sum("positives").over(run)
    rate = F.col("positives") * F.lit(100.0) / F.col("n")
    base = F.sum("positives").over(whole) * F.lit(100.0) / F.sum("n").over(whole)
    return leaves.select(
        F.row_number().over(order).alias("node_no"), "node_id", "path", "rule", F.col("n").alias("node_size"),
        size.alias("cumulative_size"), F.round(size * F.lit(100.0) / F.sum("n").over(whole), 2).alias("cumulative_pct"),
        F.col("positives").alias("target_count"), hits.alias("cumulative_target_count"),
        rate.alias("target_rate"), F.round(hits * F.lit(100.0) / size, 2).alias("cumulative_target_rate"),
        (F.try_divide(rate, base) * F.lit(100.0)).alias("lift"))


def node_rates(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Target and other rate of every node, with lift x 100 (NULL without a base rate)."""
    nodes = node_table(df, model, weight_col)
    base = F.max(F.when(F.col("node_id") == ROOT, F.try_divide("positives", "n"))).over(Window.partitionBy())
    rate = F.try_divide("positives", "n")
    return nodes.select("node_id", "path", "is_terminal", "n", "positives", (F.col("n") - F.col("positives")).alias("others"),
                        (rate * 100.0).alias("target_rate"), (100.0 - rate * 100.0).alias("other_rate"),
                        (F.try_divide(rate, base) * 100.0).alias("lift"))


def class_shares(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """``(node_id, y, n, share)``: class distribution of every node."""
    counts = node_class_counts(df, model, weight_col=weight_col)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("node_id")))


def evaluate_nodes(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Accuracy of each node's own prediction on its rows; precision, recall, F1 of the positive class."""
    nodes = node_table(df, model, weight_col).where("n > 0")
    says_yes = F.col("prediction") == model.positive
    tp = F.when(says_yes, F.col("positives")).otherwise(0)
    precision = F.when(says_yes, F.col("positives") / F.col("n")).otherwise(0.0)
    recall = F.coalesce(F.try_divide(tp, F.col("positives")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return nodes.select("node_id", "path", "is_terminal", "n", "prediction",
                        (F.col("hits") / F.col("n")).alias("accuracy"), precision.alias("precision"),
                        recall.alias("recall"), f1.alias("f1"))


def leaf_performance(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Per leaf: purity, accuracy of the stored prediction, share of the rows."""
    leaves = node_table(df, model, weight_col).where("is_terminal AND n > 0")
    top = F.greatest(*class_columns(model))
    return leaves.select("node_id", "path", "n", "prediction", (top / F.col("n")).alias("purity"),
                         (F.col("hits") / F.col("n")).alias("accuracy"),
                         (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("row_share"))


def leaf_performance_summary(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    t = leaf_performance(df, model, weight_col)
    return t.agg(F.count(F.lit(1)).alias("leaves"), F.min("purity").alias("min_purity"), F.max("purity").alias("max_purity"),
                 F.avg("purity").alias("mean_purity"), F.stddev_pop("purity").alias("std_purity"),
                 F.min("accuracy").alias("min_accuracy"), F.max("accuracy").alias("max_accuracy"),
                 F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"),
                 F.sum(F.col("accuracy") * F.col("row_share")).alias("weighted_accuracy"))


def leaf_errors(df: DataFrame, model: TreeModel, value: str) -> DataFrame:
    """Per leaf: mean of a numeric column and MSE, MAE, RMSE around that mean.

    The mean absolute error needs the mean first, so the leaf means are joined
    back from a table with one row per leaf.
    """
    routed = assign_leaf(df, model).select("leaf_id", clean_double(df, value).alias("v")).where("v IS NOT NULL")
    means = routed.groupBy("leaf_id").agg(F.avg("v").alias("mean"))
    away = F.col("v") - F.col("mean")
    return (routed.join(F.broadcast(means), "leaf_id").groupBy("leaf_id")
            .agg(F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), F.avg(away * away).alias("mse"),
                 F.avg(F.abs(away)).alias("mae")).withColumn("rmse", F.sqrt("mse")))


def tree_summary(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """One row: nodes, leaves, depth, leaf size and impurity statistics on ``df``."""
    t = node_table(df, model, weight_col)
    leaf = F.col("is_terminal")
    return t.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(leaf).alias("leaves"), F.max("depth").alias("depth"),
        F.avg(F.when(leaf, F.col("depth"))).alias("mean_leaf_depth"), F.min(F.when(leaf, F.col("n"))).alias("min_leaf_size"),
        F.max(F.when(leaf, F.col("n"))).alias("max_leaf_size"), F.avg(F.when(leaf, F.col("n"))).alias("mean_leaf_size"),
        F.avg("impurity").alias("mean_impurity"), F.min("impurity").alias("min_impurity"),
        F.max("impurity").alias("max_impurity"), F.sum(F.when(leaf, F.col("positives"))).alias("positives"),
        F.sum(F.when(leaf, F.col("n"))).alias("rows"))


def feature_usage(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Splits per feature and the rows that pass them."""
    return node_table(df, model, weight_col).where("NOT is_terminal").groupBy(F.col("split_feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("splits"), F.min("depth").alias("first_depth"), F.sum("n").alias("rows_split"))


def level_summary(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Per depth: nodes, leaves, rows, mean and weighted impurity."""
    return node_table(df, model, weight_col).groupBy("depth").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("is_terminal").alias("leaves"), F.sum("n").alias("rows"),
        F.avg("impurity").alias("mean_impurity"),
        F.try_divide(F.sum(F.col("impurity") * F.col("n")), F.sum("n")).alias("weighted_impurity"))


def split_quality(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Per split node: impurity reduction (absolute, relative), balance, child impurity statistics."""
    t = node_table(df, model, weight_col)
    kids = t.where("parent_id IS NOT NULL AND n > 0").select(
        F.col("parent_id").alias("node_id"), F.col("n").alias("k"), F.col("impurity").alias("ki"))
    whole = F.sum("k").over(Window.partitionBy("node_id"))
    share = F.col("k") / F.col("_all")
    sides = kids.withColumn("_all", whole).groupBy("node_id").agg(
        (F.sum(F.col("k") * F.col("ki")) / F.sum("k")).alias("below"), F.count(F.lit(1)).alias("children"),
        F.abs(F.sum(-share * F.log2(share))).alias("_h"), F.min("ki").alias("min_child_impurity"),
        F.max("ki").alias("max_child_impurity"), F.avg("ki").alias("mean_child_impurity"),
        F.stddev_pop("ki").alias("std_child_impurity"))
    reduction = F.col("impurity") - F.col("below")
    return t.where("NOT is_terminal").join(F.broadcast(sides), "node_id").select(
        "node_id", "split_feature", "n", F.col("impurity").alias("parent_impurity"),
        F.col("below").alias("child_impurity"), reduction.alias("reduction"),
        F.try_divide(reduction, F.col("impurity")).alias("relative_reduction"),
        F.when(F.col("children") > 1, F.col("_h") / F.log2("children")).alias("balance"),
        "min_child_impurity", "max_child_impurity", "mean_child_impurity", "std_child_impurity")


def important_nodes(df: DataFrame, model: TreeModel, decrease: float = 0.1, size_factor: float = 2.0,
                    accuracy: float = 0.9, weight_col: str | None = None) -> DataFrame:
    """Splits with a large decrease, leaves far above mean size, leaves above the accuracy."""
    t = node_table(df, model, weight_col)
    splits = split_quality(df, model, weight_col).where(F.col("reduction") > decrease).select(
        "node_id", F.lit("large_decrease").alias("reason"))
    leaves = t.where("is_terminal").withColumn("_mean", F.avg("n").over(Window.partitionBy()))
    large = leaves.where(F.col("n") > F.col("_mean") * size_factor).select("node_id", F.lit("large_leaf").alias("reason"))
    exact = leaves.where((F.col("n") > 0) & (F.col("hits") / F.col("n") > accuracy)).select(
        "node_id", F.lit("accurate_leaf").alias("reason"))
    return splits.unionByName(large).unionByName(exact)


def compare_nodes(df: DataFrame, model: TreeModel, a: int, b: int, weight_col: str | None = None) -> DataFrame:
    """Differences of two nodes: depth, rows, impurity, rate, accuracy."""
    facts = ("depth", "n", "impurity", "rate", "accuracy")
    t = node_table(df, model, weight_col).where(F.col("node_id").isin(a, b)).withColumns({
        "rate": F.try_divide("positives", "n"), "accuracy": F.try_divide("hits", "n")})

    def of(node: int, column: str) -> Column:
        return F.max(F.when(F.col("node_id") == node, F.col(column)))

    return t.agg(
        F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"),
        F.coalesce(of(a, "parent_id") == of(b, "parent_id"), F.lit(False)).alias("is_sibling"),
        *[(of(a, c) - of(b, c)).alias(f"{c}_difference") for c in facts],
        (of(a, "prediction") == of(b, "prediction")).alias("same_prediction"))


def relatives(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Each node against its parent (size ratio, impurity reduction) and siblings (ranks)."""
    t = node_table(df, model, weight_col)
    up = t.select(F.col("node_id").alias("parent_id"), F.col("n").alias("pn"), F.col("impurity").alias("pi"))
    by_size = Window.partitionBy("parent_id").orderBy(F.desc("n"), "node_id")
    by_purity = Window.partitionBy("parent_id").orderBy("impurity", "node_id")
    return t.where("parent_id IS NOT NULL").join(F.broadcast(up), "parent_id").select(
        "node_id", "parent_id", F.try_divide("n", "pn").alias("size_ratio"),
        (F.col("pi") - F.col("impurity")).alias("impurity_reduction"),
        F.row_number().over(by_size).alias("size_rank"), F.row_number().over(by_purity).alias("purity_rank"))


def purity(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Gini, entropy and dominant share of every node."""
    counts = class_columns(model)
    top = F.greatest(*counts)
    return node_table(df, model, weight_col).select("node_id", "n", impurity(counts, "gini").alias("gini"),
                                        impurity(counts, "entropy").alias("entropy"),
                                        (F.try_divide(top, F.col("n")) * 100.0).alias("dominant_pct"))
